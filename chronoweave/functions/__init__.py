"""Part of chronoweave; see the modules."""
