"""Query registry and the shared input views.

The views map the TPC-H-like tables to molecules, modes and samples. Spark and DuckDB run the
same view text, so both engines see the same input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitable.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "atoms_v": """
        SELECT l_orderkey AS mol_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                   l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS INT) AS atom_idx,
               CASE l_partkey % 6 WHEN 0 THEN 'H' WHEN 1 THEN 'C' WHEN 2 THEN 'N'
                                  WHEN 3 THEN 'O' WHEN 4 THEN 'Cl' ELSE 'Pd' END AS element,
               CAST(l_partkey % 13 AS DOUBLE) / 6 AS x, CAST(l_suppkey % 11 AS DOUBLE) / 5 AS y,
               CAST(CAST(l_quantity AS INT) % 7 AS DOUBLE) / 4 AS z, l_discount - 0.05 AS q
        FROM lineitem""",
    "charges_v": """
        SELECT mol_id, atom_idx, 'nbo' AS scheme, q AS charge FROM atoms_v
        UNION ALL
        SELECT mol_id, atom_idx, 'hirshfeld' AS scheme, q / 2 + x / 100 AS charge FROM atoms_v""",
    "scalars_v": """
        SELECT o_orderkey AS mol_id, CAST(o_custkey % 7 AS DOUBLE) / 3 - 1 AS dip_x,
               CAST(o_custkey % 5 AS DOUBLE) / 2 - 1 AS dip_y, CAST(o_custkey % 3 AS DOUBLE) - 1 AS dip_z,
               CAST(NULL AS DOUBLE) AS total_dipole, CAST(o_custkey % 90 AS DOUBLE) + 10 AS iso,
               CAST(o_custkey % 40 AS DOUBLE) + 5 AS aniso, CAST(o_totalprice AS DOUBLE) / 100000 AS homo_lumo_gap_ev
        FROM orders""",
    "mode_ids": """
        SELECT m.mol_id, k.mode_idx FROM (SELECT DISTINCT l_orderkey AS mol_id, 1 AS one FROM lineitem) m
        JOIN (SELECT 1 AS mode_idx, 1 AS one UNION ALL SELECT 2, 1 UNION ALL SELECT 3, 1) k ON m.one = k.one""",
    "modes_v": """
        SELECT mol_id, mode_idx, CAST(1000 + (mol_id * 37 + mode_idx * 613) % 2400 AS DOUBLE) AS frequency,
               CAST((mol_id * 11 + mode_idx * 7) % 100 AS DOUBLE) / 10 AS ir
        FROM mode_ids""",
    "displacements_v": """
        SELECT a.mol_id, k.mode_idx, a.atom_idx,
               CAST((a.mol_id * 3 + k.mode_idx * 5 + a.atom_idx * 7) % 17 - 8 AS DOUBLE) / 20 AS dx,
               CAST((a.mol_id * 5 + k.mode_idx * 11 + a.atom_idx * 3) % 17 - 8 AS DOUBLE) / 20 AS dy,
               CAST((a.mol_id * 7 + k.mode_idx * 2 + a.atom_idx * 13) % 17 - 8 AS DOUBLE) / 20 AS dz
        FROM (SELECT mol_id, atom_idx, 1 AS one FROM atoms_v) a
        JOIN (SELECT 1 AS mode_idx, 1 AS one UNION ALL SELECT 2, 1 UNION ALL SELECT 3, 1) k ON a.one = k.one""",
    "samples_v": """
        SELECT l_orderkey AS id, CAST(sum(l_extendedprice) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS n_lines,
               CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(avg(l_quantity) AS DOUBLE) AS avg_qty,
               CAST(sum(l_discount) AS DOUBLE) AS sum_disc, CAST(avg(l_tax) AS DOUBLE) AS avg_tax,
               CAST(max(o_totalprice) AS DOUBLE) AS o_totalprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""",
    "classes_v": """
        SELECT d.doc_id AS id, l.quality AS y, CAST(d.n_chars AS DOUBLE) AS n_chars,
               CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS DOUBLE) AS n_words,
               CAST(length(d.text) - length(replace(d.text, '.', '')) AS DOUBLE) AS n_dots
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}

NEEDS = {
    "charges_v": ["atoms_v"],
    "modes_v": ["mode_ids"],
    "displacements_v": ["atoms_v"],
}

# Bonds of atoms_v by the connectivity rules, for the DuckDB twins.
BOND_VIEWS = {
    "pairs_v": """
        SELECT p.mol_id, p.atom_idx AS a, q.atom_idx AS b, p.element AS ea, q.element AS eb,
               sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)) AS dist
        FROM atoms_v p JOIN atoms_v q ON p.mol_id = q.mol_id AND p.atom_idx < q.atom_idx""",
    "candidates_v": """
        SELECT *, (ea IN ('F','Cl','Br','I')) AS ha, (eb IN ('F','Cl','Br','I')) AS hb,
               (ea = 'Pd' OR eb = 'Pd') AS metal
        FROM pairs_v WHERE dist > 0 AND (
            (NOT (ea = 'H' AND eb = 'H') AND NOT ((ea = 'H' OR eb = 'H') AND dist >= 1.5)
             AND CASE WHEN ea = 'Pd' OR eb = 'Pd' THEN dist <= 2.6 ELSE dist < 1.82 END)
            OR ((ea IN ('F','Cl','Br','I') OR eb IN ('F','Cl','Br','I')) AND dist > 1.8 AND dist < 2.6))""",
    "halogen_v": """
        SELECT mol_id, a, b, row_number() OVER (PARTITION BY mol_id, e ORDER BY dist, a, b) AS r
        FROM (SELECT mol_id, a, b, dist, a AS e FROM candidates_v WHERE ha
              UNION ALL SELECT mol_id, a, b, dist, b FROM candidates_v WHERE hb)""",
    "kept_v": """
        SELECT * FROM candidates_v c WHERE NOT EXISTS (
            SELECT 1 FROM halogen_v h WHERE h.mol_id = c.mol_id AND h.a = c.a AND h.b = c.b AND h.r > 1)""",
    "bonds_v": """
        SELECT mol_id, a, b, dist FROM kept_v WHERE NOT metal
        UNION ALL
        SELECT mol_id, a, b, dist FROM (
            SELECT *, row_number() OVER (PARTITION BY mol_id, CASE WHEN ea = 'Pd' THEN a ELSE b END
                                         ORDER BY dist, a, b) AS r
            FROM kept_v WHERE metal) WHERE r <= 4""",
    "ends_v": """
        SELECT mol_id, a AS atom_idx, b AS partner FROM bonds_v
        UNION ALL SELECT mol_id, b, a FROM bonds_v""",
}

_CHAIN = {
    "bonds_v": ["atoms_v", "pairs_v", "candidates_v", "halogen_v", "kept_v", "bonds_v"],
    "ends_v": ["atoms_v", "pairs_v", "candidates_v", "halogen_v", "kept_v", "bonds_v", "ends_v"],
    "pairs_v": ["atoms_v", "pairs_v"],
}


def oracle(body: str, *views: str, recursive: bool = False) -> str:
    """DuckDB text: the named views as CTEs, then `body` (which may start with further CTEs)."""
    order: list[str] = []
    for view in views:
        for need in _CHAIN.get(view, [*NEEDS.get(view, []), view]):
            if need not in order:
                order.append(need)
    texts = {**VIEWS, **BOND_VIEWS}
    ctes = [f"{n} AS MATERIALIZED ({texts[n]})" for n in order]
    head, text = ("WITH RECURSIVE " if recursive else "WITH "), body.strip()
    if text.upper().startswith("WITH "):
        return head + ", ".join(ctes + [text[5:]])
    return (head + ", ".join(ctes) + " " + text) if ctes else text


class Inputs:
    """Lazy DataFrames over one data folder.

    The view that numbers the lines of an order takes `lineitem` in partitions of at most TASK_ROWS rows on average once it has more than
    FEW_ROWS: left to merge small partitions, Spark would give every core one, as large as the table asks for.
    """

    FEW_ROWS, TASK_ROWS = 2_000_000, 500_000

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._bonds, self._parts, self._stored = spark, folder, None, None, {}

    def stored(self, *views: str) -> Inputs:
        """These inputs with some views stored once, for queries that read them several times; views on top of them read the stored ones."""
        for name in views:
            if name not in self._stored:
                self._stored[name] = cut_lineage(self.view(name))
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _lines(self) -> DataFrame:
        """lineitem, partitioned by order where it is large."""
        lines = self.table("lineitem")
        if self._parts is None:
            rows = lines.count()
            self._parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // self.TASK_ROWS)) if rows > self.FEW_ROWS else 0
        return lines.repartition(self._parts, F.col("l_orderkey")) if self._parts else lines

    def view(self, name: str) -> DataFrame:
        if name in self._stored:
            return self._stored[name]
        text, frames = VIEWS[name], {}
        for need in ("lineitem", "orders", "labels", "documents"):
            for lead in ("FROM ", "JOIN "):
                if lead + need in text:
                    frames[need] = self._lines() if need == "lineitem" and name == "atoms_v" else self.table(need)
                    text = text.replace(lead + need, lead + "{" + need + "}")
        for need in NEEDS.get(name, []):
            frames[need] = self.view(need)
            text = text.replace("FROM " + need, "FROM {" + need + "}")
        return self.spark.sql(text, **frames)

    @property
    def atoms(self) -> DataFrame:
        return self.view("atoms_v").drop("q")

    @property
    def charges(self) -> DataFrame:
        return self.view("charges_v")

    @property
    def scalars(self) -> DataFrame:
        return self.view("scalars_v")

    @property
    def modes(self) -> DataFrame:
        return self.view("modes_v")

    @property
    def displacements(self) -> DataFrame:
        return self.view("displacements_v")

    @property
    def samples(self) -> DataFrame:
        return self.view("samples_v")

    @property
    def classes(self) -> DataFrame:
        return self.view("classes_v")

    @property
    def bonds(self) -> DataFrame:
        """The bond table, stored once per query: most users of bonds read them several times."""
        from orbitable.operators.neighbours import connectivity

        if self._bonds is None:
            self._bonds = cut_lineage(connectivity(self.atoms))
        return self._bonds


def query(name: str, sql: str | None = None):
    """Register fn(inputs) -> DataFrame under `name`, with its DuckDB twin."""

    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep
