"""Where sharded and central tables come from and go to."""
