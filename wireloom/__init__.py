"""wireloom: netlist analytics on Spark."""
