"""Every operator as a query over the driver's tables; importing the modules registers them."""

from . import build, records, relational, search, sources, state, streams, text, values  # noqa: F401
