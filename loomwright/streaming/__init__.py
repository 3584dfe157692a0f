"""Message streams: the line protocol over Structured Streaming."""
