"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what is like them."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import once, ship, text_of

KINDS = ("email", "ip", "card", "phone")
#: Labels of tokens: none, then the kinds.
LABELS = 1 + len(KINDS)
#: Rows of the unary table.
SHAPES = 4096
#: Rounds of message passing at most in one document, the share of the old message kept, the change that ends it, and the posterior that adds a token.
ROUNDS, DAMPING, STILL, SURE = 200, 0.3, 1e-3, 0.9
#: Configurations that the potentials are fitted on at most (the most frequent ones of all texts), and the steps of the fit.
CONFIGURATIONS, STEPS = 200_000, 300
#: Like tokens of one label count up to so many in a configuration.
LIKE = 3
#: Digits that a card and a phone have at least and at most.
_LEAST, _MOST = {2: 13, 3: 7}, {2: 19, 3: 15}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NUMERIC = re.compile(r"[+(]?[0-9][0-9().-]*[,;:!?]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start, in time linear in the text.

    Email is found from each ``@``: the run of local characters before it, not
    before the last match's end, and a domain after it.  An ip match takes four
    numbers of a dotted chain at a time.
    """
    out = []
    if "@" in text:
        done, p = 0, text.find("@")
        while p >= 0:
            s = p
            while s > done and text[s - 1] in _LOCAL:
                s -= 1
            m = _DOMAIN.match(text, p + 1) if s < p else None
            if m:
                out.append((0, s, m.end()))
                done = m.end()
            p = text.find("@", max(p + 1, done))
    if _DIGITS.search(text):
        for m in _CHAIN.finditer(text):
            if "." in m[0]:
                parts, at = m[0].split("."), m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                        out.append((1, at, end))
                    at = end + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def shape(token: str, before: str) -> int:
    """A number for what a token looks like, its digits and letters folded by length; of one with a card's digits also whether they pass Luhn."""
    digits = "".join(_DIGITS.findall(token))
    check = str(luhn(digits)) if 13 <= len(digits) <= 19 else ""
    core = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", token)
    core = re.sub(r"[^\W0-9_]+", "a", core)
    word = re.sub(r"[^a-z]", "", before.lower())
    return zlib.crc32(f"{core}|{word if word in _CUES else ''}{check}".encode()) % SHAPES


#: Words before a token that tell its kind.
_CUES = frozenset(["phone", "tel", "call", "fax", "mobile", "email", "mail", "ip", "host", "server", "card", "visa", "number", "contact"])


def keys(token: str) -> list[str]:
    """What makes tokens alike: the same word, the same digits, the same local part."""
    word = token.lower().strip(".,;:!?()[]<>\"'")
    digits = "".join(_DIGITS.findall(token))
    out = ["w" + word] if len(word) > 3 else []
    if len(digits) >= 6:
        out.append("d" + digits[-7:])
    if "@" in word[1:]:
        out.append("w" + word.split("@")[0])
    return out


def broken(token: str, kind: int, way: int) -> str:
    """A token of a base span as the patterns don't know it: an email without its dots, an ip without its last number, a phone without plus, country or separators.

    A card gets a wrong first digit.
    """
    if kind == 0:
        local, at, domain = token.partition("@")
        return local + at + domain.split(".")[0]
    if kind == 1:
        return token.rstrip(".,;:!?").rpartition(".")[0] or token
    if kind == 3:
        short = re.sub(r"\+[0-9]{1,3}[().-]+", "", token, count=1) if way & 1 else token
        short = (short if _DIGITS.search(short) else token).replace("+", "", 1)
        return re.sub(r"[().-]", "", short) if way & 2 else short
    return _DIGITS.sub(lambda m: str((int(m[0]) + 1) % 10), token, count=1)


class Tokens:
    """The tokens with a digit or an at sign of a batch of texts: the nodes of its field.

    All other tokens are surely none, so the chain falls into runs of these.
    """

    def __init__(self, column: pa.Array):
        data, off = tx.raw(column)
        starts, ends, _ = tx.spans(data, off, tx.NOT_SPACE)
        marked = np.append(0, np.cumsum(((data >= 48) & (data <= 57)) | (data == 64)))
        keep = marked[ends] > marked[starts]
        letter = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        at = np.flatnonzero(keep)
        self.doc = np.searchsorted(off, starts[at], "right") - 1
        base = letter[off[:-1]][self.doc] if len(at) else np.zeros(0, np.int64)
        self.start, self.end = letter[starts[at]] - base, letter[ends[at]] - base
        self.text = [data[s:e].tobytes().decode() for s, e in zip(starts[at], ends[at], strict=True)]
        prior = np.maximum(at - 1, 0)
        same = (at > 0) & (np.searchsorted(off, starts[prior], "right") - 1 == self.doc)
        self.before = [data[starts[p] : ends[p]].tobytes().decode() if ok else "" for p, ok in zip(prior, same, strict=True)]
        joined = np.flatnonzero((np.diff(at) == 1) & (np.diff(self.doc) == 0))
        self.chain = np.stack([joined, joined + 1], axis=1)
        self.heads: list[tuple[int, int]] = []
        self.seen()
        # texts that may have spans at all
        plus = np.append(0, np.cumsum(data == 43))
        some = marked[off[1:]] > marked[off[:-1]]
        self.some = some | (plus[off[1:]] > plus[off[:-1]])

    def seen(self) -> None:
        """Shapes of the tokens as they stand, and the links of like ones."""
        self.shape = np.array([shape(t, b) for t, b in zip(self.text, self.before, strict=True)], np.int64)
        spaced = self._spaced()
        # a like token is linked with the first and the last before it, so any two are two steps apart at most
        last: dict[tuple[int, str], tuple[int, int]] = {}
        skip = set()
        for i, (d, t) in enumerate(zip(self.doc.tolist(), self.text, strict=True)):
            for k in keys(t) + ([spaced[i]] if i in spaced else []):
                j = last.get((d, k))
                if j is not None:
                    skip.update([(j[0], i), (j[1], i)])
                last[d, k] = (i if j is None else j[0], i)
        self.skip = np.array(sorted(skip), np.int64).reshape(-1, 2)

    def _spaced(self) -> dict[int, str]:
        """The key of a number that is written over several tokens, for each of them."""
        out: dict[int, str] = {}
        follows = set(self.chain[:, 1].tolist())
        numeric = [bool(_NUMERIC.fullmatch(t)) for t in self.text]
        i = 0
        while i < len(numeric):
            end = i + 1
            while numeric[i] and end < len(numeric) and end in follows and numeric[end]:
                end += 1
            if end - i > 1:
                digits = "".join(_DIGITS.findall("".join(self.text[i:end])))
                if 7 <= len(digits) <= 19:
                    out.update(dict.fromkeys(range(i, end), "d" + digits[-7:]))
            i = end
        return out

    def mask(self) -> None:
        """Break every other base span at its first token, in the ways that hide it from the patterns; its label stays.

        Which ones is told by a hash of the token and its place, so of a
        repeated address some stay whole.  Of cards only those with a like token
        are broken: a long number that fails Luhn is no card by its shape alone.
        """
        linked = set(self.skip.ravel().tolist())
        for i, kind in self.heads:
            code = zlib.crc32(f"{self.text[i]}|{self.start[i]}".encode())
            if code & 1 and (kind != 2 or i in linked):
                self.text[i] = broken(self.text[i], kind, code >> 1)
        self.seen()

    def base(self, column: pa.Array) -> tuple[dict[int, list], np.ndarray]:
        """Base spans of each text that has any, and the label that they give each token, 0 for none."""
        found = {int(i): s for i in np.flatnonzero(self.some) if (s := base_spans(column[int(i)].as_py() or ""))}
        label = np.zeros(len(self.doc), np.int64)
        lo = np.searchsorted(self.doc, np.arange(len(column) + 1))
        for i, spans in found.items():
            a, b = lo[i], lo[i + 1]
            for k, s, e in reversed(spans):
                hit = (self.start[a:b] < e) & (self.end[a:b] > s)
                label[a:b][hit] = k + 1
                if hit.any():
                    self.heads.append((int(a + hit.argmax()), k))
        return found, label


def _configured(field: Tokens, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of a known label its shape, and in one number its label, its neighbours' (LABELS where there is none) and how many like tokens have each label."""
    left, right = np.full(len(label), LABELS), np.full(len(label), LABELS)
    left[field.chain[:, 1]] = label[field.chain[:, 0]]
    right[field.chain[:, 0]] = label[field.chain[:, 1]]
    like = np.zeros((len(label), LABELS), np.int64)
    for x, y in (field.skip.T, field.skip.T[::-1]):
        sure = label[y] < LABELS
        np.add.at(like, (x[sure], label[y[sure]]), 1)
    code = np.minimum(like, LIKE) @ (LIKE + 1) ** np.arange(LABELS)
    known = label < LABELS
    return field.shape[known], (((code * (LABELS + 1) + right) * (LABELS + 1) + left) * LABELS + label)[known]


def _open(field: Tokens, label: np.ndarray) -> np.ndarray:
    """Labels with LABELS, not known, for tokens outside base spans that are like one inside: whether the pattern or the likeness is right is what the field has to tell."""
    out = label.copy()
    for x, y in (field.skip.T, field.skip.T[::-1]):
        out[x[(label[x] == 0) & (label[y] > 0)]] = LABELS
    return out


def _both(edges: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both ends of edges where they are known."""
    ends = label[edges]
    ends = ends[(ends < LABELS).all(axis=1)]
    return ends[:, 0], ends[:, 1]


def counted(docs: DataFrame) -> DataFrame:
    """Counts (what, a, b, n) that the potentials come from, over all texts, half of whose base spans are broken.

    Tokens whose label the patterns leave open are in none of the counts.
    u: shape and label; t: labels of neighbours; s: labels of like tokens; c:
    shape and configuration.
    """

    def run(batches):
        for batch in tx.slices(batches):
            field = Tokens(batch.column(0))
            _, label = field.base(batch.column(0))
            field.mask()
            label = _open(field, label)
            known = label < LABELS
            what, code = [], []
            for name, x, y, wide in (
                ("u", field.shape[known], label[known], LABELS),
                ("t", *_both(field.chain, label), LABELS),
                ("s", *_both(field.skip, label), LABELS),
                ("c", *_configured(field, label), 1 << 20),
            ):
                pair, n = np.unique(x * wide + y, return_counts=True)
                what += [name] * len(pair)
                code.append(np.stack([pair // wide, pair % wide, n], axis=1))
            rows = np.concatenate(code)
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), *[pa.array(rows[:, k]) for k in range(3)]], names=["what", "a", "b", "n"])

    ship(docs.sparkSession)
    parts = docs.select(text_of(docs).alias("text")).mapInArrow(run, "what string, a long, b long, n long")
    return parts.groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame) -> Field:
    """The field of a table: all counts of shapes and pairs, and the CONFIGURATIONS most frequent configurations, of which the driver sees no more."""
    rows = counted(docs).orderBy(F.col("what") == "c", F.desc("n"), "what", "a", "b").limit(SHAPES * LABELS + 2 * LABELS**2 + CONFIGURATIONS)
    return Field([tuple(r) for r in rows.collect()])


class Field:
    """Log potentials: of a label for a shape, and of two labels for neighbours and for like tokens.

    Counts of shapes and pairs give them; with configurations they are fitted
    from there by conditional pseudo-likelihood, each token's label given its
    shape and the labels of its neighbours and of the tokens like it.
    """

    def __init__(self, rows: list[tuple]):
        unary, chain, skip = np.zeros((SHAPES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
        seen = sorted((a, b, n) for what, a, b, n in rows if what == "c")
        for what, a, b, n in rows:
            if what == "u":
                unary[a, b] += n
            elif what != "c":
                table = chain if what == "t" else skip
                table[a, b] += n
                table[b, a] += n
        prior = (unary.sum(axis=0) + 1) / (unary.sum() + LABELS)
        self.unary = np.log((unary + 2 * prior) / (unary.sum(axis=1, keepdims=True) + 2))
        self.chain, self.skip = (self._gain(t) for t in (chain, skip))
        if seen:
            self._fit(np.array(seen, np.int64))

    def _fit(self, rows: np.ndarray) -> None:
        """Adam steps on the pseudo-likelihood, with a normal prior around the counted potentials."""
        at, code, n = rows.T
        y, code = code % LABELS, code // LABELS
        left, code = code % (LABELS + 1), code // (LABELS + 1)
        right, code = code % (LABELS + 1), code // (LABELS + 1)
        like = (code[:, None] // (LIKE + 1) ** np.arange(LABELS) % (LIKE + 1)).astype(float)
        total, used = n.sum(), np.unique(at)
        place = np.searchsorted(used, at)
        sides, flat = np.eye(LABELS + 1), np.arange(LABELS)
        start = [self.unary[used], self.chain, self.skip]
        now = [x.copy() for x in start]
        mean, square = [np.zeros_like(x) for x in start], [np.zeros_like(x) for x in start]
        for step in range(1, STEPS + 1):
            unary, chain, skip = now
            score = unary[place] + np.vstack([chain, np.zeros(LABELS)])[left] + np.vstack([chain.T, np.zeros(LABELS)])[right] + like @ skip
            score = np.exp(score - score.max(axis=1, keepdims=True))
            error = score / score.sum(axis=1, keepdims=True)
            error[np.arange(len(y)), y] -= 1
            error *= (n / total)[:, None]
            own = np.bincount((place[:, None] * LABELS + flat).ravel(), error.ravel(), len(used) * LABELS).reshape(-1, LABELS)
            alike = like.T @ error
            slope = [own, (sides[left].T @ error)[:LABELS] + (sides[right].T @ error)[:LABELS].T, (alike + alike.T) / 2]
            for k in range(3):
                g = slope[k] + (now[k] - start[k]) / total
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                now[k] = now[k] - 0.05 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-12)
        self.unary = self.unary.copy()
        self.unary[used], self.chain, self.skip = now

    @staticmethod
    def _gain(table: np.ndarray) -> np.ndarray:
        """How much likelier two labels stand together than apart."""
        table = table + 0.5 + 4 * np.eye(LABELS)
        joint = table / table.sum()
        alone = joint.sum(axis=1)
        return np.clip(np.log(joint / np.outer(alone, alone)), -3, 3)

    def posterior(self, tokens: Tokens, label: np.ndarray) -> np.ndarray:
        """Marginals of each token by loopy message passing; tokens of base spans keep their labels.

        Each document runs until its own messages are still (or ROUNDS rounds),
        so its marginals don't depend on the others of the batch.
        """
        unary = self.unary[tokens.shape].copy()
        given = label > 0
        unary[given] = -30
        unary[given, label[given]] = 0
        edges = np.concatenate([tokens.chain, tokens.skip])
        if len(edges):
            pair = np.concatenate([np.repeat(self.chain[None], len(tokens.chain), 0), np.repeat(self.skip[None], len(tokens.skip), 0)])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message, doc = np.zeros((len(source), LABELS)), tokens.doc[source]
            at = np.arange(len(source))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                out = belief[source[at]] - message[back[at]]
                new = np.logaddexp.reduce(out[:, :, None] + pair[at], axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                new = DAMPING * message[at] + (1 - DAMPING) * new
                moving = np.zeros(doc.max() + 1, bool)
                moving[doc[at[np.abs(new - message[at]).max(axis=1) >= STILL]]] = True
                message[at] = new
                at = at[moving[doc[at]]]
                if not len(at):
                    break
            np.add.at(unary, target, message)
        unary -= np.logaddexp.reduce(unary, axis=1, keepdims=True)
        return np.exp(unary)

    def added(self, tokens: Tokens, label: np.ndarray) -> dict[int, list]:
        """Spans of tokens outside base spans that are surely of a kind and could be one, trimmed.

        An email or ip is one token; a card or phone may go over neighbours, but
        not from one complete number to the next.
        """
        if not len(label):
            return {}
        p = self.posterior(tokens, label)
        best = np.where((label == 0) & (p[:, 1:].max(axis=1) >= SURE), p[:, 1:].argmax(axis=1) + 1, 0)
        near = {tuple(x) for x in tokens.chain.tolist()}
        out: dict[int, list] = {}
        k = 0
        while k < len(best):
            if not best[k]:
                k += 1
                continue
            end = k
            while (end, end + 1) in near and best[end + 1] == best[k] and _goes_on(int(best[k]) - 1, tokens.text[k : end + 1], tokens.text[end + 1]):
                end += 1
            text = " ".join(tokens.text[k : end + 1])
            lead = len(text) - len(text.lstrip(".,;:!?[]<>\"'"))
            tail = len(text) - len(text.rstrip(".,;:!?()[]<>\"'"))
            s, e = int(tokens.start[k]) + lead, int(tokens.end[end]) - tail
            if e > s and _plausible(int(best[k]) - 1, text):
                out.setdefault(int(tokens.doc[k]), []).append((int(best[k]) - 1, s, e))
            k = end + 1
        return out


def _goes_on(kind: int, text: list[str], more: str) -> bool:
    """Whether a number that has these tokens may go on with the next."""
    if kind < 2 or text[-1][-1] in ",;:!?":
        return False
    have, new = len(_DIGITS.findall("".join(text))), len(_DIGITS.findall(more))
    return have + new <= _MOST[kind] and not (have >= _LEAST[kind] and (new >= _LEAST[kind] or more.startswith("+")))


def _plausible(kind: int, text: str) -> bool:
    n = len(_DIGITS.findall(text))
    if kind == 0:
        return "@" in text[1:]
    if kind == 1:
        return text.count(".") >= 3 and n >= 4
    return _LEAST[kind] <= n <= _MOST[kind]


def found(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row; with ``carry``, the row's place and its spans as numbers.

    The potentials are grouped counts over all of ``docs``; a second pass over
    the texts finds the spans.  A null or empty text has none.  Rows stand for
    themselves, so repeated ids and extra columns change nothing.  No shuffle
    but for the counts, of which there are no more than shapes times labels.
    """
    field = fitted(docs)

    def run(batches):
        for batch in tx.slices(batches):
            tokens = Tokens(batch.column(1))
            base, label = tokens.base(batch.column(1))
            more = field.added(tokens, label)
            n, digest, spans = np.zeros((batch.num_rows, len(KINDS)), np.int64), [], []
            for i in range(batch.num_rows):
                own = base.get(i, [])
                for k, _, _ in own:
                    n[i, k] += 1
                digest.append(hashlib.sha256(rendered(own).encode()).hexdigest())
                spans.append(rendered(sorted(own + more.get(i, []))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n[:, k]) for k in range(len(KINDS))], pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns whatever their names, with personal data replaced by its kind; n_chars, if there is one, counted again where the text changes.

    Null and empty texts stay as they are; overlapping spans are one, of the
    kind that starts first, the longer one of a tie.  Repeated rows are alike.
    An empty table gives none.
    """
    field = fitted(docs)

    def run(column: pa.Array) -> pa.Array:
        parts = []
        for batch in tx.slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
            tokens = Tokens(batch.column(0))
            base, label = tokens.base(batch.column(0))
            more = field.added(tokens, label)
            parts.append(pa.array([None if t is None else redact(t, base.get(i, []) + more.get(i, [])) if i in base or i in more else t for i, t in enumerate(batch.column(0).to_pylist())], pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    ship(docs.sparkSession)
    out = docs.select(F.struct("*").alias("row"), once(F.arrow_udf(run, "string"))(F.col("text")).alias("clean"))
    changed = ~F.col("clean").eqNullSafe(F.col("row.text"))
    own = {"text": F.col("clean"), "n_chars": F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(own[c] if c in own else F.col("row")[c]).alias(c) for c in docs.columns])
