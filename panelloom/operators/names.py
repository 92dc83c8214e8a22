"""Match free-form names to entities; report what did not match."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import once
from ..functions.text import normalize_text

# Task functions travel whole: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most aliases of one automaton.
SHARD = 100_000


def canonical_name(value: Column | str, aliases: Sequence[tuple[str, str]]) -> Column:
    """Entity of a name, by an ordered list of (alias, entity) kept in code.

    An exact alias wins; otherwise the first alias in list order found anywhere
    in the normalised name; otherwise NULL.  The list is part of the query, so
    this is an expression: no join, no shuffle.
    """
    table = F.array(
        *[F.struct(F.lit(a).alias("alias"), F.lit(e).alias("entity")) for a, e in aliases]
    )

    def match(name: Column) -> Column:
        exact = F.filter(table, lambda p: p["alias"] == name)
        inside = F.filter(table, lambda p: F.contains(name, p["alias"]))
        return F.coalesce(F.get(exact, F.lit(0))["entity"], F.get(inside, F.lit(0))["entity"])

    return once(normalize_text(value), match)


def canonicalize(
    df: DataFrame, column: str, aliases: Sequence[tuple[str, str]], out: str = "entity"
) -> DataFrame:
    return df.withColumn(out, canonical_name(column, aliases))


class _Finder:
    """An automaton over aliases (an Arrow table of alias, entity, ord): a name is walked once, whatever the number of aliases."""

    def __init__(self, table):
        import ahocorasick
        import pyarrow.compute as pc

        table = table.filter(pc.is_valid(table.column("alias"))).sort_by([("ord", "ascending"), ("alias", "ascending")])
        self.table = table.combine_chunks()
        self.first: dict[str, int] = {}
        for place, alias in enumerate(self.table.column("alias").to_pylist()):
            self.first.setdefault(alias, place)
        self.automaton = ahocorasick.Automaton()
        for alias, place in self.first.items():
            if alias:
                self.automaton.add_word(alias, place)
        if len(self.automaton):
            self.automaton.make_automaton()

    def places(self, names: list) -> tuple[list, list]:
        """Of each name, the alias it equals and the first one inside it (None: there is none)."""
        exact = [self.first.get(x) for x in names]
        if not len(self.automaton):
            return exact, [None] * len(names)
        inside = [min((p for _, p in self.automaton.iter(x)), default=None) if x and e is None else None for x, e in zip(names, exact)]
        return exact, inside

    def found(self, keys, names):
        """keys, exact, inside and ord of a batch of names."""
        import pyarrow as pa

        exact, inside = (pa.array(x, pa.int64()) for x in self.places(names.to_pylist()))
        take = lambda column, at: self.table.column(column).combine_chunks().take(at)
        columns = [*keys, take("entity", exact), take("entity", inside), take("ord", inside)]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=["_h1", "_h2", "exact", "inside", "ord"])


def _one_automaton(aliases):
    """Names against a table of at most ``SHARD`` aliases, which every task has."""
    kept = []

    def run(batches):
        if not kept:
            kept.append(_Finder(aliases.value))
        for batch in batches:
            yield kept[0].found(batch.columns[:2], batch.column(2))

    return run


def _automata(batches):
    """Sorted rows of shards: first a shard's aliases, of which an automaton is made, then the names that meet it."""
    import pyarrow as pa

    shard, rows, finder = None, [], None
    for batch in batches:
        keys, kinds = batch.column("shard").to_numpy(), batch.column("is_name").to_pylist()
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start] and kinds[end] == kinds[start]:
                end += 1
            if keys[start] != shard:
                shard, rows, finder = keys[start], [], None
            part = batch.slice(start, end - start)
            if not kinds[start]:
                rows.append(part.select(["alias", "entity", "ord"]))
            else:
                finder = finder or _Finder(pa.Table.from_batches(rows, part.select(["alias", "entity", "ord"]).schema))
                yield finder.found([part.column("_h1"), part.column("_h2")], part.column("name"))
            start = end


def canonicalize_by_table(
    df: DataFrame, column: str, aliases: DataFrame, out: str = "entity", shard: int = SHARD
) -> DataFrame:
    """As :func:`canonicalize` for an alias *table* ``(alias, entity, ord)`` of any size.

    Each distinct name is walked once by an automaton over the aliases.  The aliases are counted first: up to ``shard`` of them are
    sent to all tasks; more are cut into shards, and a name meets every shard, aliases first, so a task holds the automaton
    of one shard and a batch of names.  Names are known by 128 bits of hashes from then on.
    """
    raw = F.col(column)
    key = ["_h1", "_h2"]
    # the second hash starts from another value; hashing the name first would make it a function of the first
    hashes = [F.xxhash64(raw).alias("_h1"), F.xxhash64(F.lit("other"), raw).alias("_h2")]
    names = df.select(raw.alias("raw"), *hashes).distinct().select(*key, normalize_text("raw").alias("name"))
    aliases = aliases.select("alias", "entity", "ord").where(F.col("alias").isNotNull())
    kinds = {f.name: f.dataType for f in aliases.schema.fields}
    fields = [("_h1", T.LongType()), ("_h2", T.LongType()), ("exact", kinds["entity"]), ("inside", kinds["entity"]), ("ord", kinds["ord"])]
    schema = T.StructType([T.StructField(*f) for f in fields])
    n = aliases.count()
    if n <= shard:
        sent = df.sparkSession.sparkContext.broadcast(aliases.toArrow())  # counted just now
        found = names.mapInArrow(_one_automaton(sent), schema)
    else:
        shards = -(-n // shard)
        usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        splits = max(1, usual // shards)
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        empty = {c: F.lit(None).cast(t) for c, t in {**kinds, "name": "string", "_h1": "long", "_h2": "long"}.items()}
        columns = ["shard", "split", "is_name", "_h1", "_h2", "name", "alias", "entity", "ord"]
        ruled = aliases.select("*", F.pmod(F.xxhash64("alias"), F.lit(shards)).cast("int").alias("shard"), every(splits).alias("split"), F.lit(False).alias("is_name"))
        ruled = ruled.withColumns({c: empty[c] for c in ("_h1", "_h2", "name")}).select(columns)
        asked = names.select("*", every(shards).alias("shard"), F.pmod(F.col("_h2"), F.lit(splits)).cast("int").alias("split"), F.lit(True).alias("is_name"))
        asked = asked.withColumns({c: empty[c] for c in ("alias", "entity", "ord")}).select(columns)
        order = ["shard", "split", "is_name"]
        met = ruled.unionByName(asked).repartition(shards * splits, "shard", "split").sortWithinPartitions(*order)
        found = met.withColumn("shard", F.col("shard") * splits + F.col("split")).mapInArrow(_automata, schema)
        found = found.groupBy(*key).agg(F.max("exact").alias("exact"), F.min_by("inside", "ord").alias("inside"))
    matched = found.select(*key, F.coalesce("exact", "inside").alias(out))
    return df.withColumns(dict(zip(key, hashes))).join(matched, key, "left").select(*[F.col(f"`{c}`") for c in df.columns], out)


def unmatched_names(df: DataFrame, name: str, entity: str) -> DataFrame:
    """Distinct source names that belong to no entity."""
    return df.where(F.col(entity).isNull() & F.col(name).isNotNull()).select(name).distinct()


def unmatched_entities(targets: DataFrame, df: DataFrame, entity: str) -> DataFrame:
    """Target entities that no source row maps to."""
    return targets.select(entity).distinct().join(df.select(entity), entity, "left_anti")
