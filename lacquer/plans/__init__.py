"""The registered queries over the tables of a scale-factor folder, and their SQL twins."""
