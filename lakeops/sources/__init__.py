"""Sources, generators and sinks."""
