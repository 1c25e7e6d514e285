"""Tables that change as a whole: shadows are written beside what is active, and become active in one step.

A snapshot set has slots (an object's extraction, a workspace's vector space, its access lists), each with one active table and any number of
shadows. Writing a shadow touches nothing that is read. Activating says which table must be active now: if another writer was first it is a
Conflict, and nothing has changed. Readers take all slots that they need from one version, so they never see half of a change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import manifest


def _fingerprint(df: DataFrame) -> str:
    """Of the rows, in whatever order: sums over two hashes of each."""
    names = sorted(df.columns)
    n, a, b = df.agg(F.count("*"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(7), *names).cast("decimal(38,0)"))).first()
    return f"{','.join(names)}:{n}:{a or 0}:{b or 0}"


def shadow(spark: SparkSession, root: str, slot: str, rows: DataFrame, name: str | None = None) -> str:
    """Writes a shadow table of a slot; its name. Rows that the active table or a shadow of that name has already aren't written again."""
    mark = _fingerprint(rows)
    known = manifest.latest(spark, root).entries.get(slot, {})
    for k, t in known.get("tables", {}).items():
        if t["mark"] == mark and k == (name or known.get("active")):
            return k
    folder, name = uuid.uuid4().hex, name or uuid.uuid4().hex
    rows.write.parquet(f"{root}/{slot}/{folder}")

    def change(now: dict) -> dict:
        own = now.get(slot, {"active": None, "tables": {}})
        return {**now, slot: {**own, "tables": {**own["tables"], name: {"folder": folder, "mark": mark}}}}

    manifest.update(spark, root, change)
    return name


def activate(spark: SparkSession, root: str, wanted: dict[str, tuple[str | None, str]], keep: bool = True) -> manifest.Version:
    """Makes tables active, all or none: slot -> (the one that must be active now, the one to be). keep: the former ones stay as shadows."""

    def change(now: dict) -> dict:
        out = dict(now)
        for slot, (expected, name) in wanted.items():
            own = now.get(slot, {"active": None, "tables": {}})
            if name not in own["tables"]:
                raise KeyError(f"{slot} has no table {name}")
            if own["active"] == name:
                continue
            if own["active"] != expected:
                raise manifest.Conflict(f"{own['active']} is active in {slot}, not {expected}")
            tables = own["tables"] if keep or expected is None else {k: t for k, t in own["tables"].items() if k != expected}
            out[slot] = {"active": name, "tables": tables}
        return out

    # what another writer does to other slots is no conflict: the change is made again on top of it
    for _ in range(8):
        base = manifest.latest(spark, root)
        try:
            made = change(base.entries)
            return manifest.commit(spark, root, base, made)
        except manifest.Conflict:
            if manifest.latest(spark, root).number == base.number:
                raise
    raise manifest.Conflict("other writers were first eight times")


def replace(spark: SparkSession, root: str, slot: str, rows: DataFrame) -> bool:
    """Makes ``rows`` the active table of a slot, whatever was active; False, and no new version, if it holds these rows already."""
    before = manifest.latest(spark, root)
    name = shadow(spark, root, slot, rows)
    if before.entries.get(slot, {}).get("active") == name:
        return False
    while True:
        active = manifest.latest(spark, root).entries[slot]["active"]
        try:
            activate(spark, root, {slot: (active, name)}, keep=False)
            return True
        except manifest.Conflict:
            continue


def read(spark: SparkSession, root: str, slots: list[str], version: manifest.Version | None = None) -> dict[str, DataFrame]:
    """The active tables of slots, all as of one version."""
    entries = (version or manifest.latest(spark, root)).entries
    out = {}
    for slot in slots:
        own = entries.get(slot, {})
        if own.get("active") is None:
            raise KeyError(f"nothing is active in {slot}")
        out[slot] = spark.read.parquet(f"{root}/{slot}/{own['tables'][own['active']]['folder']}")
    return out
