"""Part of chatvitals."""
