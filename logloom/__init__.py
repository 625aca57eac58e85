"""Analytics over quorum-replicated, segmented append logs, as DataFrame and SQL plans."""

__version__ = "0.1.0"
