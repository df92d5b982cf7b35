class RequestError(ValueError):
    """A request names a column, option or group that the data cannot serve."""
