"""Steps within a group that depend on each other, in Arrow batches of whole groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def chosen_rows(df: DataFrame, key: str, order: list, columns: tuple[str, ...], pick, added: dict[str, str] | None = None, many: bool = False) -> DataFrame:
    """Rows of each group that `pick` chooses, in its order. It gets the group's columns as arrays,
    in `order` (nested columns as Arrow arrays), and returns places and an array for each of
    `added`, names and types of new columns. With `many` it gets whole runs of groups and before
    the columns the places where groups begin and the last ends. Groups are dealt by a hash and sorted in their partitions, and a task goes through
    them batch by batch: a group's rows stand together, many groups share a batch. One group at
    a time is held whole, so groups must be such as a page or a table."""
    added = added or {}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {n} {t}" for n, t in added.items())

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(names.index(key))
            # rows of a group that goes on are kept as they come and joined once
            if held and held[-1].column(names.index(key))[-1] == of[0] and of[0] == of[-1]:
                held.append(batch)
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            group = t.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist()]
            yield from chosen(t, cuts)
            held = t.slice(cuts[-1]).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from chosen(t, [0, t.num_rows])

    def chosen(t, cuts):
        flat = [t.column(c).combine_chunks() for c in columns]
        arrays = [a if pa.types.is_nested(a.type) else a.to_numpy(zero_copy_only=False) for a in flat]
        picked = []
        for lo, hi in [(0, cuts[-1])] * bool(cuts[-1]) if many else zip(cuts, cuts[1:]):
            got = pick(*([np.array(cuts)] if many else []), *(a[lo:hi] for a in arrays))
            places, *more = got if isinstance(got, tuple) else (got,)
            picked.append((lo + places, *more))
        if picked:
            out = t.take(pa.array(np.concatenate([p[0] for p in picked])))
            for k, name in enumerate(added, 1):
                out = out.append_column(name, pa.array(np.concatenate([p[k] for p in picked])))
            yield from out.combine_chunks().to_batches()

    names = df.columns
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
