"""Fingerprints of op1 against a plain version of the contract, on whole texts."""

from __future__ import annotations

import re

import xxhash

from skein.llm import simhash

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text: str | None) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def test_op1_fingerprints_and_components(spark):
    """Each document's fingerprint, and components of those that differ in two bits at most."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    got = {r.doc_id: r for r in simhash.op1_simhash(spark, SMALL).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == want
    root = {i: i for i in want}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(want)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (int(want[a], 16) ^ int(want[b], 16)).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {i: r.component_id for i, r in got.items()} == {i: top(i) for i in ids}
