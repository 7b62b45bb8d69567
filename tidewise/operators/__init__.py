"""DataFrame -> DataFrame operators of the forecasting workflow."""
