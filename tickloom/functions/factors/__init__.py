"""Factor families as expressions over rolling primitives."""
