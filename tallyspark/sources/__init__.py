"""Where events and logs come from."""
