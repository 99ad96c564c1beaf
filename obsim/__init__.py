"""obsim: observed-versus-simulated analytics as PySpark DataFrame operators."""
