"""DataFrame to DataFrame operators; all lazy, none loops over rows on the driver."""
