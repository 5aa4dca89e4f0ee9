"""The library's queries over the test tables, by subject; importing registers them."""

from . import causes, checks, curves, describe, designs, inference, models, networks, points, replicates, sequences, structure, trees, validation, vectors  # noqa: F401
