"""Personal data by a skip-chain conditional random field over entity candidates.

Nodes of a document's graph, in order of place:

* base entities, found by fixed patterns (email, ip, card, phone): observed, their label is fixed;
* other tokens with a digit or an at sign, numbers written over blanks and parentheses, and tokens that repeat the
  local part of an observed address: free.
  All other words have the label "none" for certain, so they part the chain and need no node.

Factors: a node's shape and the words before it (softmax weights); neighbours within GAP characters (a weight for
each pair of labels); and skip edges between nodes with the same key, however far: the same digits at the end
(numbers), the same local part (addresses), the same token. Skip edges link an occurrence to the next one and each
free one to the first observed one with its key (to the first, if none is observed), so their number is linear in the
occurrences and evidence doesn't fade from repeat to repeat. Loopy message passing, run until messages settle, makes
labels of such nodes agree; a free node whose marginal for an entity label is at least SURE becomes a span.

Weights are learned piecewise from all nodes of at most SAMPLE documents (least hash of the id; one text an id), labelled by the base patterns and, for
secrets, by a cue with a long token after it.

Nulls, empties, repeats: a null or empty text has no spans; rows repeat as they are; null ids are kept; an empty table gives an
empty result; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
NONE = len(KINDS)
L = NONE + 1
SAMPLE = 2000
GAP, SURE = 40, 0.8
#: Damped messages settle in some tens of rounds; the bound only ends what would swing for ever.
MOST_ROUNDS = 1000

# Each is linear in the text: runs are possessive, and what starts within a run can't match unless the run does.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUNS = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++")
_STOP = re.compile(r"\.(?![A-Za-z0-9])")
_IN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = frozenset(" \t\r\n\"'<>()[]{},;:=|\u00a0")
_TRIM = ".,!?*#$%&-_"
_HIT = re.compile(r"[0-9@]+")
_RUN = re.compile(r"[0-9]++(?:[ ().\u00a0-]{1,3}[0-9]++)++")
_CUE = re.compile(r"(token|secret|passw(?:or)?d|api[_ -]?key|key|bearer)\W{0,6}\Z", re.I)
_CUES = [re.compile(p, re.I) for p in (r"token|secret|passw|key|bearer", r"phone|tel\b|call|fax|mobile", r"card|visa|credit", r"\bip\b|host|addr", r"mail|contact")]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _IN_LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:  # what was read for nothing isn't read again: no match can start before the sign
            done = at + 1
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base entities, by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an at sign, without marks at their ends."""
    done = 0
    for m in _HIT.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and text[start - 1] not in _EDGE:
            start -= 1
        while end < len(text) and text[end] not in _EDGE:
            end += 1
        done = end
        while start < end and text[start] in _TRIM:
            start += 1
        while end > start and text[end - 1] in _TRIM:
            end -= 1
        if end > start:
            yield start, end


def _digits(token: str) -> str:
    return "".join(c for c in token if "0" <= c <= "9")


def _numbers(text: str, known: dict[tuple, str]) -> dict[tuple[int, int], tuple]:
    """Span: key of numbers over blanks and parentheses: runs of 7 to 15 digits, and stretches of any run that have the key of a number in ``known`` (its digits by key) or of such a run."""
    known, found, runs = dict(known), {}, []
    for m in _RUN.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0])]
        digits = _digits(m[0])
        runs.append((groups, digits))
        if 7 <= len(digits) <= 15 and re.search("[ ()\u00a0]", m[0]) and _apart(text, groups[0][0], groups[-1][1]):
            key = ("digits", digits[-9:])
            known[key] = max(known.get(key, ""), digits, key=len)
            found[_opened(text, groups[0][0], groups[-1][1])] = key
    for groups, digits in runs if known else ():
        at = np.cumsum([0, *(b - a for a, b in groups)]).tolist()
        for last in range(1, len(groups)):
            end = at[last + 1]
            for n in (7, 8, 9):
                key = ("digits", digits[max(0, end - n) : end])
                if key not in known or end < n:
                    continue
                first = last
                while at[first] > end - n:
                    first -= 1
                if n < 9 and at[first] < end - n:
                    continue
                while first and known[key].endswith(digits[at[first - 1] : end]):
                    first -= 1
                if first < last and _apart(text, groups[first][0], groups[last][1]):
                    found[_opened(text, groups[first][0], groups[last][1])] = key
    return found


def _opened(text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch with the parenthesis before it, if that is closed inside."""
    inside = text[start:end]
    return (start - (text[start - 1 : start] == "(" and ")" in inside.partition("(")[0]), end)


def _apart(text: str, start: int, end: int) -> bool:
    """No letter, digit or at sign beside the stretch."""
    return not re.match(r"[\w@]", text[start - 1 : start]) and not re.match(r"[\w@]", text[end : end + 1])


def _key(kind: int, token: str) -> tuple | None:
    digits = _digits(token)
    if kind == 0:
        return "local", token.split("@")[0].lower()
    if "@" in token:
        return "local", token.split("@")[0].lower()
    if len(digits) >= 7 and len(digits) * 2 >= len(token):
        return "digits", digits[-9:]
    return ("token", token) if len(token) >= 8 else None


def graph(text: str) -> list[tuple[int, int, int, tuple | None]]:
    """Nodes (kind or NONE if free, start, end, key), by start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    nodes = [(k, a, b, _key(k, text[a:b])) for k, a, b in base]
    tokens = list(_tokens(text))
    keys = [(n[3], n[1], n[2]) for n in nodes] + [(_key(NONE, text[a:b]), a, b) for a, b in tokens]
    known: dict[tuple, str] = {}
    for key, a, b in keys:
        if key and key[0] == "digits":
            known[key] = max(known.get(key, ""), _digits(text[a:b]), key=len)
    observed = _reach(taken)
    numbers = {(a, b): k for (a, b), k in _numbers(text, known).items() if observed(b - 1) <= a}
    within = _reach(sorted(numbers))
    free = [*numbers, *((a, b) for a, b in tokens if len(_digits(text[a:b])) >= 7 or within(a) < b)]
    free += _repeats(text, {n[3][1] for n in nodes if n[0] == 0 and len(n[3][1]) >= 5 and re.search(r"[._0-9]", n[3][1])})
    at = 0
    for a, b in sorted(set(free)):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if any(x < b and a < y for x, y in taken[at : at + 4]):
            continue
        key = numbers.get((a, b)) or _key(NONE, text[a:b])
        nodes.append((NONE, a, b, ("local", text[a:b].lower()) if key is None or not re.search("[0-9@]", text[a:b]) else key))
    return sorted(nodes, key=lambda n: (n[1], n[2], n[0]))


def _repeats(text: str, locals_: set[str]) -> Iterator[tuple[int, int]]:
    """Where one of ``locals_`` stands by itself, in any case: from the start of a run of such characters to its end, or to a stop with no letter or digit after it."""
    longest = max(map(len, locals_), default=0)
    for m in _RUNS.finditer(text) if locals_ else ():
        start, end = m.span()
        ends = [end] if text[end : end + 1] != "@" else []
        ends += [start + k.start() for k in _STOP.finditer(text[start : min(end, start + longest + 1) + 1]) if start + k.start() < end]
        for stop in ends:
            if stop - start <= longest and text[start:stop].lower() in locals_:
                yield start, stop


def _reach(spans: list[tuple[int, int]]):
    """Of sorted spans: the furthest end of those that start at or before a place."""
    starts, ends = [a for a, _ in spans], [0, *accumulate((b for _, b in spans), max)]
    return lambda at: ends[bisect.bisect_right(starts, at)]


def edges_of(nodes: list[tuple[int, int, int, tuple | None]]) -> list[tuple[int, int, int]]:
    """(i, j, 0) for neighbours; (i, j, 1) for skip edges: to the next node with the key, and from its hub to each free node."""
    near, far, last, hub = [], set(), {}, {}
    for x, (kind, _, _, key) in enumerate(nodes):
        if key is not None and (key not in hub or kind != NONE and nodes[hub[key]][0] == NONE):
            hub[key] = x
    for x, (kind, a, _, key) in enumerate(nodes):
        if x and a - nodes[x - 1][2] <= GAP:
            near.append((x - 1, x, 0))
        if key is not None:
            if key in last:
                far.add((last[key], x, 1))
            last[key] = x
            if kind == NONE and hub[key] != x:
                far.add((min(hub[key], x), max(hub[key], x), 1))
    return near + sorted(far)


N_FEATURES = 22


def features(text: str, start: int, end: int) -> list[float]:
    token, before = text[start:end], text[max(0, start - 24) : start]
    n, digits = len(token), sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    groups = re.split(r"[ .()-]+", token.strip("+"))
    return [
        1.0, digits == n, 7 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 15, digits == 16, digits > 16, digits < 4,
        "@" in token, token[:1] == "+", token.count(".") == 3 and digits + 3 == n, len(groups) > 1, letters > 0 and digits > 2,
        n >= 16 and letters > 3 and digits > 3, n >= 30, bool(re.fullmatch(r"[0-9a-f]{16,}", token)) and letters > 0,
        bool(_CUE.search(before)), *(bool(c.search(before)) for c in _CUES),
    ]


def label_of(text: str, node: tuple) -> int:
    """The label to learn: a base entity's kind; a secret after a cue; else none."""
    kind, a, b, _ = node
    return 4 if kind == NONE and b - a >= 16 and _CUE.search(text[max(0, a - 24) : a]) else kind


class Field:
    """Weights: [label, feature], [label, label] for neighbours, one for skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: float):
        self.unary, self.chain, self.skip = unary, chain, np.eye(L) * skip

    def marginals(self, scores: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Label marginals of the nodes by loopy sum-product; edges (i, j, 0 chain or 1 skip)."""
        if edges:
            i, j, kind = np.array(edges).T
            weight = np.stack([self.chain, self.skip])[kind]
            source, target = np.r_[i, j], np.r_[j, i]
            weight = np.concatenate([weight, weight.transpose(0, 2, 1)])
            back = np.r_[np.arange(len(i)) + len(i), np.arange(len(i))]
            said = np.zeros((len(source), L))
            for _ in range(MOST_ROUNDS):
                belief = scores.copy()
                np.add.at(belief, target, said)
                out = (belief[source] - said[back])[:, :, None] + weight
                top = out.max(axis=1, keepdims=True)
                out = top[:, 0] + np.log(np.exp(out - top).sum(axis=1))
                out -= out.max(axis=1, keepdims=True)
                change, said = np.abs(out - said).max(), 0.5 * (said + out)
                if change < 1e-3:
                    break
            scores = scores.copy()
            np.add.at(scores, target, said)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans), by kind, then start."""
        if not text:
            return [], []
        nodes = graph(text)
        base = sorted((k, a, b) for k, a, b, _ in nodes if k != NONE)
        if len(base) == len(nodes):
            return base, base
        scores = np.zeros((len(nodes), L))
        for x, (kind, a, b, _) in enumerate(nodes):
            if kind == NONE:
                scores[x] = self.unary @ np.array(features(text, a, b), float)
            else:
                scores[x] = -30.0
                scores[x, kind] = 0.0
        p = self.marginals(scores, edges_of(nodes))
        label = p[:, :NONE].argmax(axis=1)
        more = [(int(label[x]), a, b) for x, (kind, a, b, _) in enumerate(nodes) if kind == NONE and p[x, label[x]] >= SURE]
        return base, sorted(base + more)


def fit(rows: np.ndarray, labels: np.ndarray, chain: np.ndarray, agree: tuple[int, int], times: np.ndarray) -> Field:
    """Piecewise training: softmax regression for nodes, log ratios of label pairs for neighbours, log odds of agreement for skip edges."""
    unary = np.zeros((L, N_FEATURES))
    unary[NONE, 0] = 4.0
    if len(rows):
        want = np.eye(L)[labels]
        momentum = np.zeros_like(unary)
        for _ in range(400):
            z = rows @ unary.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            momentum = 0.9 * momentum + ((p - want) * times[:, None]).T @ rows / times.sum() + 1e-4 * unary
            unary -= 0.5 * momentum
    pairs = chain + 1.0
    ratio = np.log(pairs * pairs.sum() / (pairs.sum(axis=1, keepdims=True) * pairs.sum(axis=0, keepdims=True)))
    return Field(unary, np.clip((ratio + ratio.T) / 2, -2, 2), float(np.clip(np.log((agree[0] + 1) / (agree[1] + 1)), 1.0, 4.0)))


def _emit_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice of texts: the distinct features with label of all nodes, as bits, with their numbers; those of label pairs of neighbours, and of skip edges that agree or not."""
    for batch in common.slices(batches):
        seen, near, far = Counter(), [0] * (L * L), [0, 0]
        for text in common.column(batch, "text"):
            nodes = graph(text)
            labels = [label_of(text, n) for n in nodes]
            last = {}
            for k, (n, label) in enumerate(zip(nodes, labels)):
                seen[sum(1 << i for i, v in enumerate(features(text, n[1], n[2])) if v), label] += 1
                if k and n[1] - nodes[k - 1][2] <= GAP:
                    near[labels[k - 1] * L + label] += 1
                if n[3] is not None:
                    if n[3] in last and (last[n[3]], label) != (NONE, NONE):
                        far[last[n[3]] != label] += 1
                    last[n[3]] = label
        yield pa.record_batch({"x": pa.array([[x for x, _ in seen]], pa.list_(pa.int64())), "y": pa.array([[y for _, y in seen]], pa.list_(pa.int64())), "times": pa.array([list(seen.values())], pa.list_(pa.int64())), "near": pa.array([near], pa.list_(pa.int64())), "far": pa.array([far], pa.list_(pa.int64()))})


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field learned from at most ``sample`` of ``docs`` (doc_id, text); texts stay in their tasks."""
    some = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.join(F.broadcast(some.distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    return _fitted(found.mapInArrow(_emit_examples, "x array<long>, y array<long>, times array<long>, near array<long>, far array<long>").toArrow())


def _fitted(found: pa.Table) -> Field:
    seen, chain, agree = Counter(), np.zeros((L, L)), np.zeros(2, np.int64)
    for r in found.to_pylist():
        for x, y, n in zip(r["x"], r["y"], r["times"]):
            seen[x, y] += n
        chain += np.array(r["near"], float).reshape(L, L)
        agree += np.array(r["far"], np.int64)
    examples = sorted(seen)
    rows = np.array([[x >> i & 1 for i in range(N_FEATURES)] for x, _ in examples], float).reshape(-1, N_FEATURES)
    labels = np.array([y for _, y in examples], np.int64)
    return fit(rows, labels, chain, tuple(agree.tolist()), np.array([seen[e] for e in examples], float))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _emit_spans(own: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = []
            for text in common.column(batch, "text"):
                base, every = own.spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(BASE)]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            types = (*[pa.int64()] * BASE, pa.string(), pa.string(), pa.int64())
            made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *made], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return run


def find(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, numbers of base spans, base_sha256, spans (base and added), n_added."""
    rows = common.id_text(docs, id_col=id_col, text_col=text_col)
    return rows.mapInArrow(_emit_spans(learn(rows, sample)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with [KIND] for each span; of overlapping spans the first (longest, if they start together) names the whole stretch."""
    out, done, spans = [], 0, sorted((a, -b, k) for k, a, b in spans)
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, -b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its texts replaced; all columns stay, nulls stay null."""
    own = learn(common.id_text(docs, id_col=id_col, text_col=text_col), sample)

    return common.map_texts(docs, text_col, lambda texts: [redacted(t, own.spans(t)[1]) for t in texts])
