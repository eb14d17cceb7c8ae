"""The sequential state fold: numpy models that read one event after the other."""
