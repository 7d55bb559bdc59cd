"""Part of the tidewire analytics engine."""
