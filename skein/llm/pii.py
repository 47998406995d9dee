"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. A random field over a
document's tokens with digits or @ adds what they miss: neighbours are linked in a chain, and
each token to the next one of the same digits or the same letters, however distant, so that
labels agree across the document. What the patterns find is known to the field; loopy belief
propagation gives the labels of all other tokens.

Weights are learned by pseudo-likelihood: the label of each token given its shape and the
labels of the tokens it is linked to, over all documents at once. A token's shape leaves out
the plus sign by which the patterns tell a phone number, so that a number in another form
can be known by its links. Equal cases are counted by Spark, and the weights are fitted to
the counts, whose number is bounded by the shapes and not by the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import prepare, read_documents

KINDS = ("email", "ip", "card", "phone")
#: Rounds of message passing, and the probability from which a label counts.
ROUNDS, SURE = 12, 0.9
#: Digits of a number that stands in several tokens, as few as a phone number's and as many as a card's.
SHORT, LONG = 7, 19
#: A span that the field adds has this many digits, or an @ for an address, so that no lone part of a number is reported.
MIN_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 7}
STEPS, RATE = 400, 0.3
#: Messages that are worked out together.
LINKS = 100_000
#: Before any data, linked tokens of one label are this much likelier, as a logarithm; the data move it.
AGREE, TRUST = 4.0, 1e-2

_SPACES = " \t\n\x0b\x0c\r"
_ENDS = ".,;:!?()[]\"'"
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: from its middle it would need what the run's beginning has too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_MARK = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\t-\r]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, from each @ outward: a match begins where the letters before its @ do."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all pattern matches that pass their tests, kind by kind."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or @; all others are certain to be no entity."""
    out, mark = [], _MARK.search(text)
    while mark:
        start = mark.start()
        low = out[-1][1] if out else 0
        while start > low and text[start - 1] not in _SPACES:
            start -= 1
        end = _WORD.match(text, mark.start()).end()
        out.append((start, end))
        mark = _MARK.search(text, end)
    return out


def _features(token: str) -> list[int]:
    """Numbers of the features of a token's shape: how many digits, dots, dashes and letters it has, its marks, and whether its digits can be a card's or an address's."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    dots, dashes = token.count("."), token.count("-")
    out = [0, 1 + min(digits, 20), 22 + min(dots, 4), 27 + min(dashes, 4), 32 + min(letters, 6)]
    out += [39 + i for i, c in enumerate("@_%/:$#") if c in token]
    number = _DIGITS.sub("", token)
    if len(number) >= 13:
        out.append(91 if luhn(number) else 92)
    if dots == 3 and not letters:
        out.append(93 if all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in token.strip(_ENDS).split(".")) else 94)
    return out


FEATURES = 96


@dataclass
class Field:
    """unary (FEATURES, 5), chain, skip and near (5, 5): log potentials of labels 0, none, and 1 to 4, KINDS; skip is of one text or number, near of numbers whose ends alone agree."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    near: np.ndarray


@dataclass
class Graph:
    """Nodes of many documents: which document, their spans, features, and links of the three sorts."""

    doc: list[int]
    span: list[tuple[int, int]]
    features: list[list[int]]
    chain: np.ndarray
    skip: np.ndarray
    near: np.ndarray
    label: np.ndarray


def _table(features: list[list[int]]) -> np.ndarray:
    table = np.zeros((len(features), FEATURES))
    for i, own in enumerate(features):
        table[i, own] = 1
    return table


def _one_number(a: str, a_known: bool, b: str, b_known: bool) -> bool:
    """Whether two rows of digits are one number, the shorter without what stands before it: a country code in one, a nought in its place in the other. What a pattern found is whole, so nothing longer is that number."""
    a, b = a.lstrip("0"), b.lstrip("0")
    if a_known != b_known:
        whole, part = (a, b) if a_known else (b, a)
    else:
        part, whole = sorted((a, b), key=len)
    return len(part) >= 7 and whole.endswith(part)


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    """Nodes for tokens, and for neighbouring tokens without letters that make one number of SHORT to LONG digits together.

    A node is linked to the latest one of the same text, and by its number to the latest of
    each different number of the same last seven digits: as the same, or as one that only
    ends alike. What is part of a pattern's find, and has seven digits itself, has the number of the whole find. What either sort of link says is learned.
    """
    doc, span, rows, chain, skip, label = [], [], [], [], [], []

    # Links that a number has to all others of its ending grow with their square, so they are kept as arrays.
    many: list[list[np.ndarray]] = [[], []]

    def node(d: int, a: int, b: int, features: list[int], own: int, token: str, digits: str, seen: dict[str, dict]) -> None:
        if token:
            met = seen.setdefault("t" + token, {})
            skip.extend((i, len(span)) for i in met.values())
            met[""] = len(span)
        if len(digits) >= 7:
            met = seen.setdefault("d" + digits[-7:], {})
            same_text = skip[-1][0] if skip and skip[-1][1] == len(span) else -1
            ends: list[list[int]] = [[], []]
            for (other, known), i in met.items():
                if i != same_text:
                    ends[not _one_number(digits, own > 0, other, known)].append(i)
            for links, found in zip(many, ends, strict=True):
                if found:
                    links.append(np.array([found, [len(span)] * len(found)], np.int32))
            met.pop((digits, own > 0), None)
            met[digits, own > 0] = len(span)
        doc.append(d)
        span.append((a, b))
        rows.append(features)
        label.append(own)

    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        seen: dict[str, dict] = {}
        ordered = sorted((a, b, kind) for kind, a, b in base)
        p, last, run = 0, None, []
        for a, b in candidates(text):
            token = text[a:b]
            digits = _DIGITS.sub("", token)
            while p < len(ordered) and ordered[p][1] <= a:
                p += 1
            own, whole = next(((kind + 1, _DIGITS.sub("", text[x:y])) for x, y, kind in ordered[p : p + 4] if x < b and y > a), (0, ""))
            if last is not None and text[span[last][1] : a].strip(_SPACES) == "":
                chain.append((last, len(span)))
            else:
                run = []
            last = len(span)
            node(d, a, b, _features(token), own, token.strip(_ENDS).lower(), whole if whole and len(digits) >= 7 else digits, seen)
            if any(c.isalpha() for c in token):
                run = []
                continue
            if not digits:
                continue
            run.append((a, digits, own))
            while len(run) > 1 and sum(len(x) for _, x, _ in run) > LONG:
                run = run[1:]
            for n in range(2, len(run) + 1):
                some = run[-n:]
                number = "".join(x for _, x, _ in some)
                if SHORT <= len(number) <= LONG and len({x for _, _, x in some}) == 1:
                    node(d, some[0][0], b, [*_features(number), 81 + min(n, 9)], own, "", whole or number, seen)
    pairs = lambda x: np.array(x, dtype=np.int64).reshape(-1, 2)
    joined = lambda own, links: np.concatenate([pairs(own), *[x.T for x in links]]).astype(np.int64)
    return Graph(doc, span, rows, pairs(chain), joined(skip, many[0]), joined([], many[1]), np.array(label, dtype=np.int64))


def _cases(g: Graph) -> Counter:
    """How often each case occurs: a token's features, its label, and how many tokens of each label it is linked to, in the chain, by skips and by like ends."""
    around = np.zeros((3, len(g.label), 5), np.int64)
    for k, edges in enumerate((g.chain, g.skip, g.near)):
        for a, b in ((0, 1), (1, 0)):
            np.add.at(around[k], (edges[:, a], g.label[edges[:, b]]), 1)
    lists = around.transpose(1, 0, 2).reshape(len(g.label), 15).tolist()
    return Counter(zip(map(tuple, g.features), g.label.tolist(), map(tuple, lists), strict=True))


def fit_cases(cases: list[tuple[list[int], int, list[int], int]]) -> Field:
    """Weights by pseudo-likelihood from cases (features, label, linked labels, how often); without cases all labels are none."""
    unary, links = np.zeros((FEATURES, 5)), np.stack([AGREE * np.eye(5)] * 2 + [np.zeros((5, 5))])
    unary[0, 0] = 1.0
    if not cases:
        return Field(unary, *links)
    x = _table([c[0] for c in cases])
    y, n = np.eye(5)[[c[1] for c in cases]], np.array([c[3] for c in cases], float)
    around = np.array([c[2] for c in cases], float).reshape(-1, 3, 5)
    n /= n.sum()
    first, speed = links.copy(), [np.full_like(unary, 1e-8), np.full_like(links, 1e-8)]
    for _ in range(STEPS):
        z = x @ unary + np.einsum("nka,kab->nb", around, links)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = (p - y) * n[:, None]
        pair = np.einsum("nka,nb->kab", around, miss)
        for w, grad, v in zip((unary, links), (x.T @ miss + 1e-6 * unary, pair + pair.transpose(0, 2, 1) + TRUST * (links - first)), speed, strict=True):
            v += grad**2
            w -= RATE * grad / np.sqrt(v)
    return Field(unary, *links)


def fit(texts: list[str]) -> Field:
    """The field of a few texts; train does the same for a table."""
    return fit_cases([(*case, n) for case, n in sorted(_cases(graph(texts, [base_spans(t) for t in texts])).items())])


def marginals(field: Field, g: Graph) -> np.ndarray:
    """Each token's label probabilities after ROUNDS of damped message passing over all documents at once; what the patterns label is given."""
    own = _table(g.features) @ field.unary
    known = np.flatnonzero(g.label)
    own[known, g.label[known]] += 60.0
    sets = [(g.chain, field.chain), (g.skip, field.skip), (g.near, field.near)]
    source = np.concatenate([np.concatenate([e[:, 0], e[:, 1]]) for e, _ in sets])
    target = np.concatenate([np.concatenate([e[:, 1], e[:, 0]]) for e, _ in sets])
    kind = np.concatenate([np.repeat([2 * k, 2 * k + 1], len(e)).astype(np.int8) for k, (e, _) in enumerate(sets)])
    pair = np.stack([x for _, w in sets for x in (w, w.T)])
    first = 2 * np.cumsum([0, *[len(e) for e, _ in sets]])
    back = np.concatenate([np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))]) + at for (e, _), at in zip(sets, first, strict=False)])  # the message the other way
    message = np.zeros((len(source), 5))
    for _ in range(ROUNDS if len(source) else 0):
        total = own.copy()
        np.add.at(total, target, message)
        new = np.empty_like(message)
        for at in range(0, len(source), LINKS):
            part = slice(at, at + LINKS)
            out = (total[source[part]] - message[back[part]])[:, :, None] + pair[kind[part]]
            top = out.max(axis=1, keepdims=True)
            new[part] = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    np.add.at(own, target, message)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(field: Field, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all spans, each sorted by kind and start."""
    bases = [base_spans(t) if _MARK.search(t) else [] for t in texts]
    g = graph(texts, bases)
    spans = [list(b) for b in bases]
    if len(g.span):
        p = marginals(field, g)
        sure = p[:, 1:].max(axis=1)
        taken: dict[int, list[tuple[int, int]]] = {}
        # the surest first, of equal ones the longest; what the field adds doesn't overlap
        found = np.flatnonzero((sure >= SURE) & (g.label == 0)).tolist()
        for i in sorted(found, key=lambda i: (-round(float(sure[i]), 2), g.span[i][0] - g.span[i][1], i)):
            kind, text = int(p[i, 1:].argmax()), texts[g.doc[i]]
            a, b = g.span[i]
            while a < b and text[a] in _ENDS:
                a += 1
            while b > a and text[b - 1] in _ENDS:
                b -= 1
            enough = "@" in text[a:b] if kind == 0 else sum(c.isdigit() for c in text[a:b]) >= MIN_DIGITS[KINDS[kind]]
            own = taken.setdefault(g.doc[i], [])
            if enough and all(b <= x or a >= y for x, y in own):
                own.append((a, b))
                spans[g.doc[i]].append((kind, a, b))
    return [(sorted(b), sorted(s)) for b, s in zip(bases, spans, strict=True)]


def _count_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cases: Counter = Counter()
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        cases.update(_cases(graph(texts, [base_spans(t) for t in texts])))
    keys = list(cases)
    columns = [pa.array([list(k[i]) for k in keys], pa.list_(pa.int32())) for i in (0, 2)]
    yield pa.RecordBatch.from_arrays([columns[0], pa.array([k[1] for k in keys], pa.int32()), columns[1], pa.array(list(cases.values()), pa.int64())], names=["features", "label", "linked", "n"])


def train(docs: DataFrame) -> Field:
    """Fit to the cases of all rows. A null or empty text has none; long texts count whole; repeated rows count each; an empty table leaves all labels none."""
    prepare(docs.sparkSession)
    marked = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    each = marked.mapInArrow(_count_cases, "features array<int>, label int, linked array<int>, n bigint")
    counted = each.groupBy("features", "label", "linked").agg(F.sum("n").alias("n")).toLocalIterator()
    return fit_cases(sorted((list(r.features), r.label, list(r.linked), r.n) for r in counted))


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, base, spans) of each row: arrays of (kind, start, end), code points and end exclusive, by kind and start.

    base has what the patterns find, spans that and what the field adds to it. A null or
    empty text has none. Long texts are searched whole. Repeated rows are reported each;
    where patterns of two kinds match one place both are reported; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(field or train(docs))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(shared.value, [t or "" for t in batch.column(1).to_pylist()])
            as_rows = lambda side: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f[side]] for f in found], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_rows(0), as_rows(1)], names=["doc_id", "base", "spans"])

    each = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {each}, spans {each}")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_documents(spark, sf_dir))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))
