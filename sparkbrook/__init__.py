"""Message-stream analytics on Spark: decode, route, aggregate by ticks, merge, deliver."""
