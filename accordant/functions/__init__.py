"""Column builders: every function here returns a Column and stays inside whole-stage codegen."""
