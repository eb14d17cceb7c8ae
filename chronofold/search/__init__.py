"""Search over architectures: spaces, controllers and the phases of a search."""
