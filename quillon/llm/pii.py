"""Personal data by rules and a skip-chain conditional random field.

The rules find e-mail and IP addresses, card and phone numbers; what they find stays.  The field labels the other
tokens that could belong to such data: words with a digit or an at sign, without the punctuation around them.

* Variables: the candidate tokens of one document, each O, email, ip, card or phone.  Tokens inside a rule's span
  are observed.
* Node potentials: weights of a token's shape, checks (Luhn, octets) and the two words before it.
* Chain edges join candidates that follow each other word by word.
* Skip edges join a candidate with earlier ones that it resembles, however far back: the last one with the same
  letters and digits, and up to ``ALIKE`` that share most of their character trigrams (a mention cut short, with a
  digit missing, changed or out of place).  Short tokens resemble nothing, for "+1" and "1" would.
* Each of the three kinds of edges has a weight by pair of labels.
* Inference: loopy belief propagation, ``ROUNDS`` rounds of messages along all edges at once, in bounded slices.

The weights maximise the penalised pseudo-likelihood of a bounded sample: up to ``SAMPLE_TOKENS`` tokens of the
documents that come first by a hash of doc_id, in blocks of up to ``BLOCK_TOKENS``.  Labels are the rules'; and so
that the field learns what the rules can't see, blocks with a rule's span also get spoilt copies of these mentions
(cut short, a character changed, missing or out of place, the prefix left out), labelled with the mention's kind.

A run of neighbouring tokens becomes a span if the belief of each in the same kind is at least ``SURE``, whether or
not the rules found anything in the document.

Defined results: null or empty text has no spans; repeated rows are searched each; a null doc_id stays null; other
columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._spark import lean

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCUMENTS, SAMPLE_BLOCKS, SAMPLE_TOKENS, BLOCK_TOKENS = 32_000, 4000, 50_000, 64
ROUNDS, SURE = 6, 0.9
ALIKE, LEAST_CORE, LEAST_SHARE = 2, 5, 0.6
_EDGE_SLICE = 1 << 15
_SLICE = 256

Span = tuple[int, int, int]

# The rules' patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
# a word from its first character on, so that a long word without a digit or at sign is looked at once
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_EDGE = ".,;:!?()[]{}<>\"'*#&$%|"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the longest name before it that no earlier match holds: what the pattern finds, in one pass."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1 if end <= at else end)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def rule_spans(text: str) -> list[Span]:
    """(start, kind, end) of the rules' spans in order of start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- the field ---------------------------------------------------------------------------------------------------


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, end of the word) of the candidate tokens, punctuation around them taken off."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            out.append((a, b, m.end()))
    return out


def _digits(token: str) -> str:
    return "".join(c for c in token if "0" <= c <= "9")


def _features(token: str, before: str) -> list[str]:
    """Names of a token's features; before: the words in front of it."""
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", token))
    digits = _digits(token)
    out = ["bias", f"shape={shape[:12]}", f"digits={min(len(digits), 20)}", f"length={min(len(token), 24) // 2}", f"first={shape[:1]}", f"dots={min(token.count('.'), 4)}", f"at={'@' in token}"]
    if 14 <= len(digits) <= 19 and len(digits) == len(token):
        out.append(f"luhn={_luhn(digits)}")
    parts = token.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    return out + [f"before{k}={w}" for k, w in enumerate(reversed(before.split(" ")[-2:])) if w]


def _before(text: str, a: int) -> str:
    """The two words before a place, in lower case without the punctuation around them, none longer than 16 characters."""
    words = text[max(0, a - 40) : a].split()[-2:]
    return " ".join(w.strip(_EDGE).lower()[-16:] for w in words)


def _core(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalnum())


def _graph(text: str, tokens: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Chain edges, skip edges of equal tokens and skip edges of similar ones, as pairs of token places."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if not text[tokens[i][2] : tokens[i + 1][0]].strip(_EDGE + " \t")]
    same: list[tuple[int, int]] = []
    alike: list[tuple[int, int]] = []
    last: dict[str, int] = {}
    holder: dict[str, int] = {}  # the last token with a trigram
    grams_of: list[set[str]] = []
    for i, (a, b, _) in enumerate(tokens):
        core = _core(text[a:b])
        grams = {core[k : k + 3] for k in range(len(core) - 2)} if len(core) >= LEAST_CORE else set()
        grams_of.append(grams)
        if not grams:
            continue
        if core in last:
            same.append((last[core], i))
        else:
            shared: dict[int, int] = {}
            for g in grams:
                j = holder.get(g)
                if j is not None:
                    shared[j] = shared.get(j, 0) + 1
            for j, _ in sorted(shared.items(), key=lambda x: (-x[1], -x[0]))[:ALIKE]:
                both, small = len(grams & grams_of[j]), min(len(grams), len(grams_of[j]))
                if 2 * both >= LEAST_SHARE * (len(grams) + len(grams_of[j])) or (both >= 4 and 5 * both >= 4 * small):
                    alike.append((j, i))
        last[core] = i
        for g in grams:
            holder[g] = i
    return [chain, same, alike]


def _labels(tokens: list[tuple[int, int, int]], spans: list[Span]) -> list[int]:
    """0 for O, else the kind of the first rule span that overlaps, plus 1."""
    out, k = [], 0
    by_start = sorted(spans)
    ends: list[Span] = []
    for a, b, _ in tokens:
        while k < len(by_start) and by_start[k][0] < b:
            ends.append(by_start[k])
            k += 1
        ends = [s for s in ends if s[2] > a]
        over = [s for s in ends if s[0] < b]
        out.append(min(over, key=lambda s: (s[0], s[1]))[1] + 1 if over else 0)
    return out


class Field:
    """Weights of the field, and inference.  edges: of each kind (chain, same, alike) a matrix by pair of labels."""

    def __init__(self, names: dict[str, int], node: np.ndarray, edges: np.ndarray) -> None:
        self.names, self.node, self.edges = names, node, edges

    def _places(self, features: list[list[str]]) -> np.ndarray:
        """The features' rows of the weights, filled up with the last, which is zero."""
        places = [[self.names[f] for f in t if f in self.names] for t in features]
        width = max(map(len, places), default=0)
        return np.array([p + [len(self.names)] * (width - len(p)) for p in places], np.int64).reshape(len(places), width)

    @classmethod
    def fit(cls, blocks: list[dict], steps: int = 300, rate: float = 0.3, prior: float = 0.1, least: int = 3) -> Field:
        """blocks: features (lists of names; those of fewer than ``least`` tokens don't count), labels and edges (three lists of pairs) of each."""
        n = len(KINDS) + 1
        count: dict[str, int] = {}
        for f in (f for b in blocks for t in b["features"] for f in t):
            count[f] = count.get(f, 0) + 1
        names = {f: i for i, f in enumerate(sorted(f for f, k in count.items() if k >= least))}
        field = cls(names, np.zeros((len(names) + 1, n)), np.zeros((3, n, n)))
        y = np.array([x for b in blocks for x in b["labels"]], np.int64)
        if not names:
            return field
        at = field._places([t for b in blocks for t in b["features"]])
        base = np.cumsum([0] + [len(b["labels"]) for b in blocks])
        pairs = [np.array([(base[i] + u, base[i] + v) for i, b in enumerate(blocks) for u, v in b["edges"][k]], np.int64).reshape(-1, 2) for k in range(3)]
        hot = np.eye(n)[y]
        squares = [np.full_like(field.node, 1e-8), np.full_like(field.edges, 1e-8)]
        for _ in range(steps):
            logits = field.node[at].sum(axis=1)
            for w, e in zip(field.edges, pairs, strict=True):
                np.add.at(logits, e[:, 1], w[y[e[:, 0]]])
                np.add.at(logits, e[:, 0], w.T[y[e[:, 1]]])
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            off = (hot - p / p.sum(axis=1, keepdims=True)) / len(y)
            node, edges = np.zeros_like(field.node), np.zeros_like(field.edges)
            np.add.at(node, at.ravel(), np.repeat(off, at.shape[1], axis=0))
            node[-1] = 0.0
            for g, e in zip(edges, pairs, strict=True):
                np.add.at(g, y[e[:, 0]], off[e[:, 1]])
                np.add.at(g.T, y[e[:, 1]], off[e[:, 0]])
            for w, g, s in ((field.node, node, squares[0]), (field.edges, edges, squares[1])):
                g -= prior / len(y) * w
                s += g * g
                w += rate * g / np.sqrt(s)
        return field

    def beliefs(self, features: list[list[str]], observed: list[int], edges: list[list[tuple[int, int]]]) -> np.ndarray:
        """(tokens, labels) beliefs after loopy propagation; observed: a label, or 0 where the rules say nothing."""
        n = self.node.shape[1]
        node = self.node[self._places(features)].sum(axis=1).reshape(-1, n)
        known = np.array(observed, np.int64)
        node[known > 0] = np.where(np.eye(n, dtype=bool)[known[known > 0]], 0.0, -50.0)
        ends = np.array([e for kind in edges for e in kind], np.int64).reshape(-1, 2)
        kind = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        u, v = ends[:, 0], ends[:, 1]
        ahead, back = np.zeros((len(u), n)), np.zeros((len(u), n))
        total = node.copy()
        for _ in range(ROUNDS if len(u) else 0):
            for k in range(0, len(u), _EDGE_SLICE):
                part = slice(k, k + _EDGE_SLICE)
                weight = self.edges[kind[part]]
                to_v = _log_sum(weight + (total[u[part]] - back[part])[:, :, None], 1)
                to_u = _log_sum(weight + (total[v[part]] - ahead[part])[:, None, :], 2)
                ahead[part], back[part] = 0.5 * ahead[part] + 0.5 * to_v, 0.5 * back[part] + 0.5 * to_u
            total = node.copy()
            np.add.at(total, v, ahead)
            np.add.at(total, u, back)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    out = np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))
    return out - out.max(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans that the field adds to the rules'."""
    tokens = candidates(text)
    observed = _labels(tokens, base)
    if all(observed):
        return []
    edges = _graph(text, tokens)
    beliefs = field.beliefs([_features(text[a:b], _before(text, a)) for a, b, _ in tokens], observed, edges)
    found = [0 if observed[i] or beliefs[i, k] < SURE else int(k) for i, k in enumerate(beliefs.argmax(axis=1))]
    linked = {e[1] for e in edges[0]}
    out: list[Span] = []
    for i, (a, b, _) in enumerate(tokens):
        if found[i] and i in linked and found[i - 1] == found[i]:
            out[-1] = (out[-1][0], found[i] - 1, b)
        elif found[i]:
            out.append((a, found[i] - 1, b))
    return out


def spoilt(mention: str, kind: int, draw: random.Random) -> str | None:
    """A copy of a mention as a hurried writer leaves it, that no rule finds; None if none comes out."""
    for _ in range(6):
        way = draw.randrange(5)
        at = draw.randrange(len(mention))
        if way == 0:  # cut short
            cut = mention[: max(LEAST_CORE, int(len(mention) * draw.uniform(0.55, 0.9)))]
            out = mention.rsplit(".", 1)[0] if kind in (0, 1) else cut
        elif way == 1:  # the prefix left out
            out = mention[max(1, len(mention) // 4) :].lstrip(" ().-")
        elif way == 2:  # a character changed
            out = mention[:at] + draw.choice("0123456789" if mention[at].isdigit() else "aeiou") + mention[at + 1 :]
        elif way == 3:  # missing
            out = mention[:at] + mention[at + 1 :]
        else:  # out of place
            out = mention[:at] + mention[at + 1 : at + 2] + mention[at] + mention[at + 2 :]
        if out != mention and candidates(out) and not rule_spans(out):
            return out
    return None


def _learning_text(text: str, base: list[Span]) -> tuple[str, list[Span]]:
    """The text with spoilt copies of some mentions at its end, and the spans of both."""
    draw = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    spans = list(base)
    for a, k, b in base[:4]:
        copy = spoilt(text[a:b], k, draw) if draw.random() < 0.6 else None
        if copy:
            spans.append((len(text) + 5, k, len(text) + 5 + len(copy)))
            text += " and " + copy
    return text, spans


_BLOCK = "doc_id long, block int, tokens array<string>, before array<string>, labels array<int>, edges array<array<int>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            text, spans = _learning_text(text, rule_spans(text))
            tokens = candidates(text)
            labels = _labels(tokens, spans)
            # the last block has the spoilt copies and what comes before them
            for k in range(0, len(tokens), BLOCK_TOKENS):
                part = tokens[k : k + BLOCK_TOKENS]
                edges = [[x for e in kind for x in e] for kind in _graph(text, part)]
                rows.append((doc_id or 0, k, [text[a:b][:64] for a, b, _ in part], [_before(text, a) for a, _, _ in part], labels[k : k + BLOCK_TOKENS], edges))
        ints = pa.list_(pa.int32())
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), ints, pa.list_(ints)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "block", "tokens", "before", "labels", "edges"])


def learn(documents: DataFrame, looked_at: int = SAMPLE_DOCUMENTS, blocks: int = SAMPLE_BLOCKS, most: int = SAMPLE_TOKENS) -> Field:
    """The field fitted on a bounded sample of documents (doc_id, text).

    As many documents are looked at as a hash of doc_id lets through, about ``looked_at`` whatever there are; the first
    blocks of their tokens by hash come to the driver.
    """
    share = min(1.0, looked_at / max(1, documents.count()))
    hashed = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = (documents if share == 1.0 else documents.where(hashed)).where(F.col("text").rlike("[0-9@]")).mapInArrow(lean(_blocks), _BLOCK)
    rows = rows.orderBy(F.xxhash64("doc_id", "block"), "doc_id", "block", "tokens").limit(blocks).collect()
    pairs = lambda x: list(zip(x[::2], x[1::2], strict=True))
    sample, n = [], 0
    for r in rows:
        n += len(r["tokens"])
        if n > most:
            break
        sample.append({"features": [_features(t, w) for t, w in zip(r["tokens"], r["before"], strict=True)], "labels": r["labels"], "edges": [pairs(x) for x in r["edges"]]})
    return Field.fit(sample)


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _worth(column: pa.Array) -> list[str]:
    """The texts; those without a digit or an at sign, in which nothing can be found, as empty ones."""
    found = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)
    return [x or "" for x in pc.if_else(found, column, "").to_pylist()]


def _replaced(column: pa.Array, changed: dict[int, str]) -> pa.Array:
    if not changed:
        return column
    mask = np.zeros(len(column), bool)
    mask[list(changed)] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array(list(changed.values()), column.type))


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (the rules'), base_sha256 and spans (all) of each row of documents."""
    rows = _plain(documents)
    model = documents.sparkSession.sparkContext.broadcast(learn(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(k, _SLICE)
                counts, digests, spans = [], [], []
                for text in _worth(batch.column("text")):
                    base = rule_spans(text)
                    counts.append([sum(s[1] == i for s in base) for i in range(len(KINDS))])
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(sorted(base + added_spans(text, base, model.value))) if text else "")
                columns = [batch.column("doc_id"), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{x}" for x in KINDS], "base_sha256", "spans"])

    return rows.mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out.append(text[at:a] + f"[{KINDS[k].upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(documents: DataFrame) -> DataFrame:
    """documents with all their columns and rows, personal data in text replaced by its kind; n_chars follows if it is there.

    Null and empty texts stay as they are (n_chars null and 0), repeated rows are redacted each, an empty table gives no rows, and
    columns beside text and n_chars, whatever their names, aren't looked at.
    """
    model = documents.sparkSession.sparkContext.broadcast(learn(_plain(documents)))
    names, kinds = documents.columns, documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(k, _SLICE)
                column = batch.column(names.index("text")).cast(pa.string())
                changed: dict[int, str] = {}
                for i, text in enumerate(_worth(column)):
                    spans = rule_spans(text)
                    spans = sorted(spans + added_spans(text, spans, model.value)) if text else spans
                    if spans:
                        changed[i] = masked(text, spans)
                columns = dict(zip(names, batch.columns, strict=True))
                columns["text"] = _replaced(column, changed).cast(batch.schema.field("text").type)
                if "n_chars" in columns:
                    columns["n_chars"] = pc.utf8_length(_replaced(column, changed)).cast(batch.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    return documents.mapInArrow(lean(run), kinds)
