"""Tree-pattern queries: compiler, per-document matcher, and the relational form of definite patterns."""
