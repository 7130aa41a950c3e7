"""Filter design, windows and small numeric functions; NumPy only, on the driver."""
