"""Column functions: no I/O, no shuffles, all inside whole-stage code where Spark allows it."""
