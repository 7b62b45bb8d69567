"""End-to-end plans: base table, training (cross-validated model choice) and
backtest. Each builds Spark plans; loops run only over model fits."""
