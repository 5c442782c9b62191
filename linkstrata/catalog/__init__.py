from linkstrata.catalog.registry import ORACLES, QUERIES  # noqa: F401
from linkstrata.catalog import company, curate, files, flow, graph, reports, standard  # noqa: F401
