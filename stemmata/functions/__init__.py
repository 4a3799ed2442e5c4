"""Column functions and the few Arrow functions behind them."""
