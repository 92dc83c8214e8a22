"""Writers and the manifest of outputs."""
