"""Ready-made query plans over the driver tables."""
