"""fluxlens: network-flow analytics and corpus operators on PySpark."""
