"""Similarity memory: documents, upsert, delete, nearest neighbours, context blocks, embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.config import SECTION_HEADS
from flowwarden.functions.text import fixed, rule_text, stable_id
from flowwarden.session import materialise, rows_within, ship_package

CORRECTIONS, INCIDENTS, RULES = "correction_analyses", "incident_summaries", "synthesized_rules"
NO_SIGNAL = "LLM unavailable"
#: Rows and bytes of vectors that may be broadcast, rows of a block, centres of the inverted file.
PACKED_ROWS, PACKED_BYTES = 20_000, 64 << 20
BLOCK_ROWS, MOST_CENTRES = 4_096, 1_024
#: Queries and documents whose distances are held at a time.
TILE_QUERIES, TILE_DOCUMENTS = 512, 2_048
#: Characters of a document that any line shows.
MOST_SHOWN = 200
PAIR_SCHEMA = "query_id string, doc_id string, distance double"


# ---- documents --------------------------------------------------------------------------------
# The wording of documents and metadata keys in this section are fixed values: stored memories use them.

def _vector_row(collection: str, doc_id: Column, document: Column, metadata: dict[str, Column], version: Column) -> list[Column]:
    pairs = [c for k, v in metadata.items() for c in (F.lit(k), v.cast("string"))]
    return [F.lit(collection).alias("collection"), doc_id.alias("doc_id"), document.alias("document"),
            F.create_map(*pairs).alias("metadata"), version.cast("long").alias("version")]


def correction_documents(corrections: DataFrame) -> DataFrame:
    """Rows for analyses worth remembering; empty ones and those of a failed model call are skipped.

    Needs event_id, mistake, analysis, context_text, corrected_at, rule_id, seq.
    """
    useful = corrections.filter((F.coalesce("analysis", F.lit("")) != "") & ~F.contains("analysis", F.lit(NO_SIGNAL)))
    event = F.col("event_id").cast("string")
    return useful.select(*_vector_row(
        CORRECTIONS,
        stable_id("corr", event, F.substring("analysis", 1, 40)),
        F.concat(F.lit("["), F.col("mistake"), F.lit("] Event "), event, F.lit(": "), F.col("analysis"),
                 F.lit(" | context: "), F.col("context_text")),
        {"event_id": event, "correction_type": F.col("mistake"), "corrected_at": F.col("corrected_at"),
         "new_rule_id": F.coalesce("rule_id", F.lit("none"))},
        F.col("seq")))


def incident_documents(decisions: DataFrame) -> DataFrame:
    """Rows for model decisions; fail-safes carry no signal. Needs context_text besides decision columns."""
    event = F.col("event_id").cast("string")
    real = decisions.filter(~F.coalesce("is_llm_failsafe", F.lit(False)))
    return real.select(*_vector_row(
        INCIDENTS,
        stable_id("inc", event, F.substring("context_text", 1, 40)),
        F.concat(F.lit("Event "), event, F.lit(" | "), F.col("context_text"), F.lit(" | Decision: "),
                 F.coalesce("playbook", F.lit("?")), F.lit(" | Reasoning: "),
                 F.substring(F.coalesce("reasoning", F.lit("")), 1, 200)),
        {"event_id": event, "playbook": F.coalesce("playbook", F.lit("?")), "timestamp": F.col("ts"),
         "fused_risk": F.coalesce(F.col("fused_risk").cast("string"), F.lit("?")),
         "threat": F.coalesce("threat", F.lit("?"))},
        F.col("seq")))


def rule_documents(rules: DataFrame) -> DataFrame:
    """Rows for learned rules; a rule without id gets a stable one from its event."""
    event = F.col("event_id").cast("string")
    rule_id = F.coalesce(F.col("id"), stable_id("rule", event))
    return rules.select(*_vector_row(
        RULES, stable_id("rule", rule_id),
        rule_text(F.col("id"), F.col("condition"), F.col("playbook"), F.col("rationale")),
        {"rule_id": rule_id, "event_id": event, "correction_type": F.col("mistake"),
         "playbook": F.coalesce("playbook", F.lit("?")), "created_at": F.col("created_at")},
        F.col("seq")))


def upsert(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Latest version per (collection, doc_id); an aggregate, so rewrites of one id combine early."""
    both = current.unionByName(fresh)
    rest = [c for c in both.columns if c not in ("collection", "doc_id")]
    newest = both.groupBy("collection", "doc_id").agg(F.max_by(F.struct(*rest), "version").alias("_r"))
    return newest.select("collection", "doc_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def delete_rules(current: DataFrame, rule_ids: DataFrame) -> DataFrame:
    """Remove rule documents by rule id; unknown ids are ignored."""
    gone = rule_ids.select(F.lit(RULES).alias("collection"), stable_id("rule", F.col("rule_id")).alias("doc_id")).distinct()
    return current.join(gone, ["collection", "doc_id"], "left_anti")


def collection_counts(current: DataFrame) -> DataFrame:
    return current.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))


# ---- embedding --------------------------------------------------------------------------------

def embed(df: DataFrame, text: str, width: int = 256) -> DataFrame:
    """Default encoder: hashed token counts, scaled to unit length. Any transformer that adds an
    `embedding` array column can take its place."""
    tokens = Tokenizer(inputCol=text, outputCol="_tokens").transform(df)
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=width).transform(tokens)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(hashed)
    return unit.withColumn("embedding", vector_to_array("_unit")).drop("_tokens", "_tf", "_unit")


def remember(current: DataFrame, documents: DataFrame, encoder=None) -> DataFrame:
    """Embed new document rows and upsert them. `encoder` is a transformer or a function of a frame
    that reads `document` and adds `embedding`; the default is the hashed one."""
    if encoder is None:
        encoded = embed(documents, "document")
    else:
        encoded = encoder.transform(documents) if hasattr(encoder, "transform") else encoder(documents)
    return upsert(current, encoded.select(*current.columns))


# ---- nearest neighbours -----------------------------------------------------------------------

def _units(vectors) -> np.ndarray:
    """Unit vectors; a zero vector stays zero and has distance 1 from everything."""
    matrix = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0.0, 1.0, norms)


def _kept(found: pd.DataFrame, n: int) -> pd.DataFrame:
    """The first n rows of every query by distance, then document id."""
    found = found.sort_values(["query_id", "distance", "doc_id"], kind="stable")
    return found[found.groupby("query_id").cumcount() < n]


def _codes(*ids: np.ndarray) -> list[np.ndarray]:
    """Numbers in the order of the ids, equal for equal ids, for each of several sides."""
    codes = pd.factorize(np.concatenate(ids), sort=True)[0]
    return np.split(codes, np.cumsum([len(i) for i in ids])[:-1])


class _Search:
    """The n nearest documents of some queries, met in several lots. `ceiling` has every query's n-th distance so far."""

    def __init__(self, q: np.ndarray, n: int, ceiling: np.ndarray | None = None):
        self.q, self.n = q, n
        self.best = np.full((len(q), n), np.inf)
        self.ceiling = np.full(len(q), np.inf) if ceiling is None else ceiling

    def meet(self, some: np.ndarray, q_codes: np.ndarray, d_codes: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of queries (of those named in `some`) and documents that may be among the n nearest, and their distances.

        Whole rows are only multiplied and compared with the ceiling; what may pass it is rounded, ordered and cut to n of a query
        by distance, then document id, in every tile. Codes are those of both sides' ids; equal ones never match.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for start, at in ((i, j) for i in range(0, len(some), TILE_QUERIES) for j in range(0, len(d), TILE_DOCUMENTS)):
            mine, own, there = some[start:start + TILE_QUERIES], q_codes[some[start:start + TILE_QUERIES]], d_codes[at:at + TILE_DOCUMENTS]
            alike = self.q[mine] @ d[at:at + TILE_DOCUMENTS].T
            least = 1.0 - self.ceiling[mine] - 2e-12
            passing = alike >= least[:, None]
            if alike.shape[1] > self.n and np.count_nonzero(passing) > 4 * self.n * len(mine):  # the tile's own n-th is a closer bound
                alike[own[:, None] == there[None, :]] = -np.inf
                passing = alike >= np.maximum(least, np.partition(alike, -self.n, axis=1)[:, -self.n] - 2e-12)[:, None]
            row, col = np.nonzero(passing)
            distance = np.round(1.0 - alike[row, col], 12)  # equal vectors tie whatever the order of sums
            kept = np.flatnonzero((distance <= self.ceiling[mine[row]] + 1e-12) & (own[row] != there[col]))
            kept = kept[np.lexsort((there[col[kept]], distance[kept], row[kept]))]
            place = np.arange(len(kept)) - np.searchsorted(row[kept], row[kept])
            kept, place = kept[place < self.n], place[place < self.n]
            row, col, distance = row[kept], col[kept], distance[kept]
            hit, which = np.unique(row, return_inverse=True)
            near = np.full((len(hit), self.n), np.inf)
            near[which, place] = distance
            hit = mine[hit]
            self.best[hit] = np.partition(np.hstack([self.best[hit], near]), self.n - 1, axis=1)[:, :self.n]
            self.ceiling[hit] = np.minimum(self.ceiling[hit], self.best[hit, self.n - 1])
            found.append((mine[row], at + col, distance))
        row, col, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = distance <= self.ceiling[row] + 1e-12
        return row[kept], col[kept], distance[kept]


def _nearest(q_ids: np.ndarray, d_ids: np.ndarray, d: np.ndarray, search: _Search) -> pd.DataFrame:
    """Up to n nearest documents of every query, ties by document id; self excluded."""
    row, col, distance = search.meet(np.arange(len(q_ids)), *_codes(q_ids, d_ids), d)
    return _kept(pd.DataFrame({"query_id": q_ids[row], "doc_id": d_ids[col], "distance": distance}), search.n) if len(row) else _NONE


_NONE = pd.DataFrame({"query_id": pd.Series(dtype=object), "doc_id": pd.Series(dtype=object), "distance": pd.Series(dtype=float)})


def _top(pairs: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "doc_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _against_packed(large: DataFrame, packed: pd.DataFrame, n: int, packed_is_corpus: bool) -> DataFrame:
    """Stream the large side past the small one, which travels as a broadcast matrix.

    No partition emits more than n rows for a query: with packed queries the best so far are carried from batch to batch.
    """
    spark = large.sparkSession
    shared = spark.sparkContext.broadcast((packed["id"].to_numpy(dtype=object), _units(packed["embedding"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        best, carried = _NONE, _Search(matrix, n)
        for batch in batches:
            if len(batch) == 0:
                continue
            own_ids, own = batch["id"].to_numpy(dtype=object), _units(batch["embedding"])
            if packed_is_corpus:
                yield _nearest(own_ids, ids, matrix, _Search(own, n))
            else:
                best = _kept(pd.concat([best, _nearest(ids, own_ids, own, carried)]), n)
        yield best

    return large.mapInPandas(scan, PAIR_SCHEMA)


def _placed(df: DataFrame, centres) -> DataFrame:
    """id, embedding, nearest centre and the straight distance to it."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                away = np.sqrt(np.maximum(0.0, _squares(_units(batch["embedding"]), centres.value)))
                near = away.argmin(axis=1)
                yield batch.assign(cluster=near, away=away[np.arange(len(batch)), near])

    return df.mapInPandas(place, "id string, embedding array<double>, cluster long, away double")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T


def _indexed(queries: DataFrame, corpus: DataFrame, n: int, block: int) -> DataFrame:
    """Both sides large: an exact inverted file.

    Documents lie in clusters around centres, at most `MOST_CENTRES` documents chosen by hash; a cluster's radius is its largest distance
    to the centre. Blocks of clusters make parts of bounded size, queries make crowds of bounded size, and each part meets each crowd
    once. In a meeting a query's n-th distance so far, at first among the centres, is its ceiling. The distance of unit vectors to any
    member is at least the distance to the centre less the radius, so clusters that cannot beat the ceiling are passed over. At most n
    rows for a query leave a meeting. A vector travels once for each part or crowd of the other side, not for each block.
    """
    spark = queries.sparkSession
    rows, asked = corpus.count(), queries.count()
    k = max(1, min(MOST_CENTRES, -(-rows // block)))
    chosen = corpus.orderBy(F.xxhash64("id"), "id").limit(k).collect()
    width = max([1, *(len(r["embedding"]) for r in chosen)])
    most = max(1, min(PACKED_ROWS, PACKED_BYTES // (8 * width)))
    crowds = max(1, -(-asked // most))
    # Parts are as large as may be while parts and crowds make three meetings a core: a query travels once for each part.
    part_rows = max(block, min(most, max(BLOCK_ROWS, rows * crowds // (3 * spark.sparkContext.defaultParallelism))))
    centres = spark.sparkContext.broadcast(_units([r["embedding"] for r in chosen]))
    centre_ids = spark.sparkContext.broadcast(np.array([r["id"] for r in chosen], dtype=object))
    docs = materialise(_placed(corpus, centres))
    sizes = sorted((r["cluster"], r["radius"], -(-r["n"] // block)) for r in
                   docs.groupBy("cluster").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect())  # one row a centre
    radius = spark.sparkContext.broadcast({c: r for c, r, _ in sizes})
    firsts = np.cumsum([0, *(m for _, _, m in sizes)]).tolist()
    together = max(1, part_rows // block)
    blocks = spark.createDataFrame([(c, f, m) for (c, _, m), f in zip(sizes, firsts, strict=False)], "cluster long, first long, blocks long")
    spread = F.xxhash64("id", "embedding")
    d = docs.join(F.broadcast(blocks), "cluster").select(
        "id", "embedding", "cluster", F.floor((F.col("first") + F.pmod(spread, F.col("blocks"))) / together).alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))).alias("crowd"))
    q = queries.select("id", "embedding", F.pmod(spread, F.lit(crowds)).cast("int").alias("crowd"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit((firsts[-1] + together - 1) // together - 1).cast("long"))).alias("part"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return _NONE
        q_ids, own = left["id"].to_numpy(dtype=object), _units(left["embedding"])
        d_ids, there, cluster = right["id"].to_numpy(dtype=object), _units(right["embedding"]), right["cluster"].to_numpy()
        present, everyone = np.unique(cluster), np.arange(len(own))
        q_codes, d_codes, c_codes = _codes(q_ids, d_ids, centre_ids.value)
        first = _Search(own, n)
        first.meet(everyone, q_codes, c_codes, centres.value)
        search = _Search(own, n, first.ceiling)
        away = np.sqrt(np.maximum(0.0, _squares(own, centres.value[present])))
        found, waiting = [_NONE], 0
        for at in np.argsort(away.mean(axis=0), kind="stable"):
            least = np.maximum(0.0, away[:, at] - radius.value[present[at]] - 1e-7) ** 2 / 2.0
            open_, members = np.flatnonzero(least <= search.ceiling + 1e-12), np.flatnonzero(cluster == present[at])
            row, col, distance = search.meet(open_, q_codes, d_codes[members], there[members])
            found.append(pd.DataFrame({"query_id": q_ids[row], "doc_id": d_ids[members[col]], "distance": distance}))
            waiting += len(row)
            if waiting > 1_000_000:
                found = [_kept(pd.concat(found), n)]
                waiting = 0
        return _kept(pd.concat(found), n)

    keys = ["part", "crowd"]
    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(meet, PAIR_SCHEMA)


def nearest(queries: DataFrame, corpus: DataFrame, n: int, packed_rows: int = PACKED_ROWS,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact n nearest documents by cosine distance: query_id, doc_id, distance, rank.

    Frames hold a text `id` and an `embedding` array; equal ids are the same item and never match.
    The side with at most `packed_rows` rows and `PACKED_BYTES` of vectors is broadcast after both were checked; when neither is
    that small the sides meet through an inverted file. An empty corpus gives no rows.
    """
    ship_package(queries.sparkSession)
    q, c = (d.select("id", F.col("embedding").cast("array<double>").alias("embedding")) for d in (queries, corpus))

    def packed(df: DataFrame) -> pd.DataFrame | None:
        if not rows_within(df.select("id"), packed_rows):  # without the vectors, which may have to be computed
            return None
        numbers = df.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
        return df.toPandas() if 8 * numbers <= PACKED_BYTES else None

    small, is_corpus = packed(c), True
    if small is None:
        small, is_corpus = packed(q), False
    if small is None:
        return _top(_indexed(q, c, n, block_rows), n)
    if len(small) == 0:
        return queries.sparkSession.createDataFrame([], PAIR_SCHEMA + ", rank int")
    return _top(_against_packed(q if is_corpus else c, small, n, is_corpus), n)


def below(found: DataFrame, ceiling: float) -> DataFrame:
    return found.filter(F.col("distance") < F.lit(ceiling))


def near_lines(queries: DataFrame, memory: DataFrame, collection: str, ceiling: float, width: int, n: int = 2) -> DataFrame:
    """query_id and `lines`: one line for each of the n nearest documents of a collection below the ceiling, nearest first.

    Items with nothing near are left out. At most n lines an item are gathered.
    """
    part = memory.filter(F.col("collection") == collection)
    near = below(nearest(queries, part.select(F.col("doc_id").alias("id"), "embedding"), n), ceiling)
    shown = near.join(part.select("doc_id", F.concat(F.lit("  - "), F.substring("document", 1, width)).alias("line")), "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return shown.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("lines"))


def context_block(queries: DataFrame, memory: DataFrame, incidents: int = 2, corrections: int = 2,
                  rules: int = 3, ceiling: float = 0.75) -> DataFrame:
    """Text block per query from its nearest incidents, corrections and rules; empty when none is near.

    At most `incidents + corrections + rules` lines per query are gathered.
    """
    similarity = fixed(F.lit(1.0) - F.col("distance"), 2)
    meta = F.col("metadata")
    number = F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "))

    def cut(width: int) -> Column:
        return F.substring("document", 1, width)

    # Whole texts are cut before they are shuffled.
    lines = {
        INCIDENTS: (0, incidents, F.concat(
            number, F.lit("Event "), meta["event_id"], F.lit(" → "), meta["playbook"], F.lit(" (risk="),
            meta["fused_risk"], F.lit(", threat="), meta["threat"], F.lit(", similarity="), similarity,
            F.lit("): "), cut(160))),
        CORRECTIONS: (1, corrections, F.concat(number, F.lit("["), meta["correction_type"], F.lit("] "), cut(180))),
        RULES: (2, rules, F.concat(number, cut(MOST_SHOWN))),
    }
    found = None
    for collection, (section, count, line) in lines.items():
        part = memory.filter(F.col("collection") == collection)
        near = below(nearest(queries, part.select(F.col("doc_id").alias("id"), "embedding"), count), ceiling)
        shown = near.join(part.select("doc_id", cut(MOST_SHOWN).alias("document"), "metadata"), "doc_id").select(
            "query_id", F.lit(section).alias("section"), "rank", line.alias("line"))
        found = shown if found is None else found.unionByName(shown)
    gathered = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("section", "rank", "line"))).alias("s"))

    def text(section: int) -> Column:
        own = F.transform(F.filter("s", lambda x: x["section"] == section), lambda x: x["line"])
        return F.when(F.size(own) > 0, F.concat_ws("\n", F.lit(SECTION_HEADS[section]), F.array_join(own, "\n")))

    blocks = gathered.select("query_id", F.concat_ws("\n", text(0), text(1), text(2)).alias("block"))
    return queries.select(F.col("id").alias("query_id")).join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("block", F.lit("")).alias("block"))

