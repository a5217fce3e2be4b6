"""Sources, decoders, encoders and sinks."""
