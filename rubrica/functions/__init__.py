"""Column builders: scoring arithmetic and text rules, all inside whole-stage codegen."""
