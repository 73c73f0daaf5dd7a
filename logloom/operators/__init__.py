"""DataFrame -> DataFrame operators over log records."""
