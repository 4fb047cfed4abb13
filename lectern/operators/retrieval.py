"""Retrieval: exact vector ranking, neighbours, graph-cited order, prompts and snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lectern.functions.scalars import l2_norm
from lectern.operators.relational import preceding_neighbours, settled
from lectern.session import new_shared_path, ship

#: Retrieval modes in canonical order.
MODES = ["NONE", "VECTOR", "PIKE"]
#: Query vectors that are ranked in one pass over the chunks: so many, and of so many bytes in double precision, at most.
MAX_QUERIES, QUERY_BYTES = 50_000, 16 << 20
#: Distances that a task has in memory at once, candidates it holds for a query, in multiples of k, and for all queries of a pass.
CELLS, SLACK, CANDIDATES = 1 << 19, 4, 1 << 19


def vector_top_k(queries: DataFrame, chunks: DataFrame, k: int = 12, digits: int = 9) -> DataFrame:
    """The k nearest chunks of every query by cosine, exactly.

    queries: query_id, vector; chunks: chunk_id, file, ordinal, embedding. Distances rank
    ascending, then by file and ordinal; last come those that are NULL: of zero vectors, NULL
    vectors or elements, and other numbers of dimensions.

    The queries are measured and go to the tasks in blocks; each block is one pass over the
    chunks, in which a task multiplies matrices and holds its own k best of each query, so what
    is shuffled is queries x k x tasks. With several blocks the passes run one by one and leave
    their hits in the shared folder.
    """
    spark = queries.sparkSession
    ship(spark)
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n // MAX_QUERIES), -(-n * 8 * max(width or 0, 1) // QUERY_BYTES), -(-n * k * SLACK // CANDIDATES))
    if blocks == 1:
        return _top_k_of_block(queries, chunks, k, digits)
    block, path = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), new_shared_path(spark, "hits")
    parts = [_top_k_of_block(queries.where(block == b), chunks, k, digits) for b in range(blocks)]
    for b, hits in enumerate(parts):
        hits.write.parquet(f"{path}/block={b}")
    return spark.read.schema(parts[0].schema).parquet(path).select(*parts[0].columns)


def _top_k_of_block(queries: DataFrame, chunks: DataFrame, k: int, digits: int) -> DataFrame:
    own = queries.select("query_id", "vector").toArrow()  # of at most QUERY_BYTES
    vectors, by_dims = own.column("vector").combine_chunks(), {}
    dims = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        by_dims[d] = rows, _units(vectors.take(pa.array(rows)), d)
    shared = chunks.sparkSession.sparkContext.broadcast((own.num_rows, by_dims))
    kinds = {c: chunks.schema[c].dataType for c in ("chunk_id", "file", "ordinal")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, by_dims = shared.value
        best = _Best(n, k)
        for batch in batches:
            for part, first in _rounded_distances(batch.column("embedding"), n, by_dims, digits):
                best.take(part, batch.slice(first, len(part)))
        if best.held is not None and best.held.num_rows:
            yield best.rows()

    fields = [StructField("query", IntegerType()), StructField("distance", DoubleType()), *[StructField(c, t) for c, t in kinds.items()]]
    found = chunks.select("embedding", *kinds).mapInArrow(run, StructType(fields))
    ids = chunks.sparkSession.createDataFrame(pa.table({"query": pa.array(range(own.num_rows), pa.int32()), "query_id": own.column("query_id")}))
    order = [F.asc_nulls_last("distance"), F.asc("file"), F.asc("ordinal")]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    top = found.withColumn("semantic_rank", rank).where(F.col("semantic_rank") <= k).join(F.broadcast(ids), "query")
    return top.select("query_id", "chunk_id", "file", "ordinal", "distance", "semantic_rank", (1 - F.col("distance")).alias("similarity"))


def _units(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one number of dimensions by their length; NaN for those that have none."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dims) if dims else np.zeros((len(vectors), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _rounded_distances(embeddings: pa.Array, n: int, by_dims: dict, digits: int) -> Iterator[tuple[np.ndarray, int]]:
    """(distances of some chunks to all queries, inf for NULL; their first row), CELLS at a time."""
    dims = pc.fill_null(pc.list_value_length(embeddings), 0).to_numpy()
    step = max(1, CELLS // max(n, 1))
    for first in range(0, len(embeddings), step):
        size = min(step, len(embeddings) - first)
        out = np.full((size, n), np.inf)
        for d, (rows, units) in by_dims.items():
            own = np.flatnonzero(dims[first : first + size] == d)
            if d and len(own):
                near = 1 - _units(embeddings.take(pa.array(own + first)), d) @ units.T
                out[np.ix_(own, rows)] = np.where(np.isnan(near), np.inf, np.round(near, digits))
        yield out, first


class _Best:
    """The k best candidates of each query so far, by distance, file and ordinal."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.held = n, k, None
        self.worst = np.full(n, np.inf)  # the k-th distance of each query that has k candidates

    def take(self, distances: np.ndarray, rows: pa.RecordBatch) -> None:
        chunk, query = np.nonzero(distances <= self.worst[None])
        new = pa.table({"query": pa.array(query, pa.int32()), "distance": distances[chunk, query], **{c: rows.column(c).take(pa.array(chunk)) for c in ("chunk_id", "file", "ordinal")}})
        self.held = new if self.held is None else pa.concat_tables([self.held, new])
        if self.held.num_rows > SLACK * self.k * self.n:
            self._prune()

    def _prune(self) -> None:
        order = pc.sort_indices(self.held, sort_keys=[(c, "ascending") for c in ("query", "distance", "file", "ordinal")], null_placement="at_start")
        table = self.held.take(order)
        query = table.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = np.flatnonzero(place == self.k - 1)
        self.worst[query[full]] = table.column("distance").to_numpy()[full]
        self.held = table.filter(pa.array(place < self.k)).combine_chunks()

    def rows(self) -> pa.RecordBatch:
        self._prune()
        out = self.held.combine_chunks()
        distance = out.column("distance").to_numpy()
        out = out.set_column(1, "distance", pa.array(distance, pa.float64(), mask=np.isinf(distance)))
        return out.to_batches()[0]


def with_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Hits and the chunks just before them in the same file.

    A neighbour has its anchor's similarity and sorts just before it; a chunk that is both a
    hit and a neighbour counts as a hit, once. The result may exceed k.
    """
    hits = settled(hits)  # they are read twice
    own = hits.select("query_id", "file", "ordinal", "chunk_id", "similarity", "semantic_rank", (F.col("semantic_rank") * 1000.0).alias("selection_order"), F.lit(False).alias("is_neighbour"))
    near = preceding_neighbours(
        hits.select("query_id", "file", "ordinal", "similarity", "semantic_rank"), chunks.select("file", "ordinal", "chunk_id"), "file", "ordinal", window
    ).select(
        "query_id", "file", "ordinal", "chunk_id", "similarity", "semantic_rank",
        (F.col("semantic_rank") * 1000.0 - (F.col("anchor_ordinal") - F.col("ordinal"))).alias("selection_order"), F.lit(True).alias("is_neighbour"),
    )
    w = Window.partitionBy("query_id", "chunk_id").orderBy("is_neighbour", "selection_order", "semantic_rank")
    return own.unionByName(near).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def parse_modes(modes: Column) -> Column:
    """Known modes, each once, in canonical order; NULL if one is unknown or none is given."""
    known = F.array(*map(F.lit, MODES))
    ok = (F.size(modes) > 0) & F.forall(modes, lambda m: F.array_contains(known, m))
    return F.when(ok, F.filter(known, lambda m: F.array_contains(modes, m)))


def cited_first(chunks: Column, concepts: Column, relations: Column) -> Column:
    """Chunk ids in the order they are given to the model: cited ones first.

    Citations count concepts before relations, first mention only; the rest keeps its order.
    """
    cited = F.array_intersect(F.array_distinct(F.concat(concepts, relations)), chunks)
    return F.concat(cited, F.array_except(F.array_distinct(chunks), cited))


#: Instructions of the prompts and titles of the evidence, by mode.
NO_SEARCH = "교과서 검색 근거는 제공되지 않습니다. 모델 자체 지식만 사용해 답하십시오."
TITLES = {"VECTOR": "단순 벡터 검색으로 찾은 교과서 근거", "PIKE": "Pike-inspired 생성 그래프 스냅샷에서 재사용·재정렬한 교과서 근거", "*": "문항에 연결된 기존 교과서 근거"}
ONLY_THIS, NOTHING_FOUND = "만 사용하십시오.\n\n", "를 찾지 못했습니다. 근거 부족을 명시하십시오."


def _numbered(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n")


def public_query(question: Column, options: Column) -> Column:
    """Retrieval query of a question: its text and numbered options, blank ones left out, never its answer."""
    given = F.filter(F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.trim(o)), lambda o: o != "")
    more = F.when(F.size(given) > 0, F.concat(F.lit("\n선택지:\n"), _numbered(given))).otherwise("")
    return F.concat(F.lit("질문: "), F.trim(question), more)


def rendered_evidence(evidence: Column) -> Column:
    """Evidence structs (page, text) as one block, numbered from 1."""
    one = lambda e, i: F.concat(F.lit("[근거 "), (i + 1).cast("string"), F.when(e.page.isNotNull(), F.concat(F.lit(" · p."), e.page.cast("string"))).otherwise(""), F.lit("]\n"), e.text)
    return F.array_join(F.transform(evidence, one), "\n\n")


def answer_prompt(mode: Column, question: Column, options: Column, evidence: Column) -> Column:
    """What a model is asked: an instruction by mode, with the evidence texts, then the question and its options."""
    title = F.when(mode == "VECTOR", TITLES["VECTOR"]).when(mode == "PIKE", TITLES["PIKE"]).otherwise(TITLES["*"])
    found = F.when(F.size(F.coalesce(evidence, F.array().cast("array<string>"))) > 0, F.concat(title, F.lit(ONLY_THIS), F.array_join(evidence, "\n\n"))).otherwise(F.concat(title, F.lit(NOTHING_FOUND)))
    asked = F.when(F.size(F.coalesce(options, F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n\n선택지:\n"), _numbered(options))).otherwise("")
    return F.concat(F.when(mode == "NONE", NO_SEARCH).otherwise(found), F.lit("\n\n[질문]\n"), question, asked)


def vector_audit(vector: Column) -> Column:
    """Dimensions, norm and hash of a query vector: sha256 of its JSON, whole numbers written without a point."""
    number = lambda x: F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("double").cast("string"))
    text = F.concat(F.lit("["), F.array_join(F.transform(vector, number), ","), F.lit("]"))
    return F.struct(F.size(vector).alias("dims"), F.round(l2_norm(vector), 6).alias("norm"), F.sha2(text, 256).alias("sha256"))


def space_mismatches(chunks: DataFrame, key: str, space: str, wanted: str) -> DataFrame:
    """Chunks per key whose vector space is not the wanted one, NULL included."""
    return chunks.groupBy(key).agg(F.count_if(~F.col(space).eqNullSafe(F.lit(wanted))).alias("mismatches"), F.count(F.lit(1)).alias("chunks"))


def scope_violations(cited: DataFrame, allowed: str = "allowed", ids: str = "cited") -> DataFrame:
    """Rows that cite chunks outside what was retrieved, with the foreign ids."""
    return cited.withColumn("foreign", F.array_except(ids, allowed)).where(F.size("foreign") > 0)


def computed_once(requests: DataFrame, keys: list[str], results: DataFrame) -> DataFrame:
    """Give every request the result of its key; results are made once per distinct key."""
    return requests.join(results, keys, "left")
