"""Filter policies: language, compiler, and the registered queries."""
