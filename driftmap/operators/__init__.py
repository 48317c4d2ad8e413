"""DataFrame operators: reads, writes, transforms, validation, change detection, privacy."""
