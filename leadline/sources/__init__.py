"""Tables, stores, archives and export."""
