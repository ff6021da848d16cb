"""Part of trackweave, a transit-network analytics library on PySpark."""
