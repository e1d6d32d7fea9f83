"""Nothing here streams: no operator of this library has windows of time, late data or state between batches."""
