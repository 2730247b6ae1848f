"""The test tables and the keys they are declared to have."""

from __future__ import annotations

from lumbre.sources.catalog import DeclaredKeys, ForeignKey

TABLES = (
    "benchmark",
    "conversations",
    "customer",
    "documents",
    "embeddings",
    "events",
    "labels",
    "lineitem",
    "nation",
    "orders",
    "pages",
    "part",
    "region",
    "supplier",
)

PRIMARY = {
    "benchmark": ("item_id",),
    "conversations": ("conv_id", "turn"),
    "customer": ("c_custkey",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "events": ("event_id",),
    "labels": ("doc_id",),
    "nation": ("n_nationkey",),
    "orders": ("o_orderkey",),
    "pages": ("page_id",),
    "part": ("p_partkey",),
    "region": ("r_regionkey",),
    "supplier": ("s_suppkey",),
}

FOREIGN = (
    ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    ForeignKey("labels", ("doc_id",), "documents", ("doc_id",)),
)

KEYS = DeclaredKeys(PRIMARY, FOREIGN)

# Column sets that look like keys but are checked without being declared; the first one does not hold.
UNDECLARED_CANDIDATES = (("lineitem", ("l_orderkey", "l_linenumber")), ("pages", ("url",)))

# A reference that does not hold, next to those that do.
BROKEN_REFERENCE = ForeignKey("documents", ("doc_id",), "labels", ("doc_id",))
