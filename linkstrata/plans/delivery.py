"""Delivery bundle: four graph files, and three company files where attachments are ready."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import gathered, join_path, lookup, stored
from linkstrata.operators import companies as C
from linkstrata.operators import export as E
from linkstrata.sources.files import write_delivery

KEY = "industry_id"


def delivery_tables(
    graphs: DataFrame, nodes: DataFrame, edges: DataFrame, l2_edges: DataFrame, projected: DataFrame, attachments: DataFrame, master: DataFrame,
    agg_paths: DataFrame, metadata: DataFrame, flow_status: DataFrame, attachment_status: DataFrame, payloads: DataFrame, as_of: str, listed_only: bool = True,
) -> dict[str, DataFrame]:
    """The seven tables of all graphs. Overlays count only where their status is ready.

    A graph without a delivery mapping, an attachment without a payload header, and two nodes that would get the same delivery id
    are errors; ``missing_metadata`` lists the first beforehand.
    """
    ready_flow = flow_status.filter(F.col("overlay_status") == "ready").select(KEY)
    ready_companies = attachment_status.filter(F.col("overlay_status") == "ready").select(KEY)
    cols = [KEY, "id", "source", "target", "relation_type", "relation_weight", "description", "confidence"]
    order = lambda df, n: df.select(*cols, (F.col("pos") if "pos" in df.columns else F.lit(0)).cast("bigint").alias("pos"), F.lit(n).alias("layer_no"))
    overlay = order(l2_edges, 1).unionByName(order(projected, 2)).join(ready_flow, KEY, "left_semi")
    all_edges = order(edges, 0).unionByName(overlay)
    a = gathered(attachments.join(ready_companies, KEY, "left_semi"), KEY, "company_id")
    people = C.payload_companies(a, master)
    if listed_only:
        a, people = C.filter_listed(a, people)
    a, people = stored(a), stored(people)  # of known size: company rows are spread by it
    node_table = E.node_rows(nodes, graphs, metadata, as_of)
    collision = E.delivery_id_collisions(node_table).select(KEY, "delivery_id").first()
    if collision is not None:
        raise ValueError(f"two nodes of {collision[KEY]} have the delivery id {collision['delivery_id']}")
    return {
        "industry_node": E.industry_rows(metadata, graphs),
        "industrynode_node": node_table,
        "industrynode_edge": E.edge_rows(all_edges, nodes, graphs, metadata, as_of),
        "industrynode_industry_edge": E.node_industry_rows(nodes, graphs, metadata, as_of),
        "company_node": E.company_rows(a, people, nodes, payloads, metadata, as_of),
        "company_industrynode_edge_node": E.company_edge_rows(a, people, nodes, agg_paths, payloads, metadata, as_of),
        "company_industrynode_edge_node_不聚合": E.company_edge_rows(a, people, nodes, agg_paths, payloads, metadata, as_of, aggregate_upward=False),
    }


HEADERS = {
    "industry_node": K.INDUSTRY_COLUMNS,
    "industrynode_node": K.NODE_COLUMNS,
    "industrynode_edge": K.EDGE_COLUMNS,
    "industrynode_industry_edge": K.NODE_INDUSTRY_COLUMNS,
    "company_node": K.COMPANY_COLUMNS,
    "company_industrynode_edge_node": K.COMPANY_EDGE_COLUMNS,
    "company_industrynode_edge_node_不聚合": K.COMPANY_EDGE_COLUMNS,
}


def write_bundle(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write every table as CSV; returns name -> folder.

    A folder per industry in each, named by the delivery name as a safe file name. Company rows are in the order of their codes over all
    part files of an industry.
    """
    names = tables["industry_node"].select(KEY, X.safe_file_name(F.col("name")).alias("file_prefix"))
    paths = {}
    for name, df in tables.items():
        paths[name] = join_path(folder, name)
        write_delivery(lookup(df, names, [KEY]), paths[name], HEADERS[name], ("节点code",) if name == "company_node" else ())
    return paths
