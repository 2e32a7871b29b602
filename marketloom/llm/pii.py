r"""Personal data: patterns, and a skip-chain conditional random field that carries labels to further mentions.

Nodes of the field are the tokens of a document that hold a digit or an at sign. Neighbouring nodes share a chain potential,
nodes of the same key (the digits of a token that has seven or more, else its lower-cased characters) a skip potential. What the
patterns find is clamped. Where they find a mention of a key, each mention is linked to the next one, and to the nearest found ones
before and after it, however far; where they find none, all mentions of the key share one hub variable, whose potential couples two
mentions as one skip link would. So the number of links grows with the text and not with its square, and what is known of a key
is one or two links away from each of its mentions.
Loopy sum-product passing runs over all documents of a batch as one graph. Labels that beliefs name firmly, in tokens that no
pattern has found, become further spans, if what they cover can be of that kind. The spans of the patterns always stay.

Weights are fitted to the patterns' labels in a bounded sample: the `sample_docs` different texts of at most `sample_chars` characters
whose hashes are smallest. They maximise the field's pseudo-likelihood, the chance of each label given its token and its neighbours'
labels, under a Gaussian prior. Unlabelled mentions of a found value say nothing, as they are what the field is to tell, and are left out.

Defined cases: a null text is an empty one and has no spans; without a sample document there are no weights and only the patterns
count; other columns pass through, those named as the added one are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import Aside, table, tidy
from marketloom.llm.secrets import digest

KINDS = ["email", "ip", "card", "phone"]
# The patterns. An e-mail address is sought from its at sign on both sides.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\s,;:!?\"'<>=|&#*$]*[0-9@][^\s,;:!?\"'<>=|&#*$]*")
OTHER = 0  # label 0; the kinds follow from 1


@dataclass(frozen=True)
class PiiRules:
    sample_docs: int = 1000
    sample_chars: int = 20_000
    rounds: int = 8
    belief: float = 0.95
    gap: int = 2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def local_part(text: str, at: int, least: int) -> int:
    """Where the local part that ends at `at` begins, not before `least`."""
    step = 64
    while True:
        low = max(least, at - step)
        run = re.search(r"[A-Za-z0-9._%+-]*\Z", text[low:at])[0]
        if len(run) < at - low or low == least:
            return at - len(run)
        step *= 4


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by pattern."""
    out, end = [], 0
    if "@" in text:
        for m in AT.finditer(text):
            start = local_part(text, m.start(), end)
            if start < m.start():
                out.append((0, start, m.end()))
                end = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def plausible(kind: int, text: str) -> bool:
    """Whether a span that the field proposes can be of its kind."""
    digits = re.sub("[^0-9]", "", text)
    if kind == 0:
        return bool(re.fullmatch(r"[^@]+@[^@]+\.[^@]+", text))
    if kind == 1:
        return four_parts(text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def four_parts(text: str) -> bool:
    return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text)) and all(int(p) <= 255 for p in text.split("."))


def shape(token: str) -> str:
    """d for each digit up to six in a run, a for a run of letters, other characters as they are."""
    s = re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]+", "a", token))
    return re.sub(r"0{6,}", "000000", s)[:40].replace("0", "d")


def features(token: str) -> tuple[str, ...]:
    """What is known of a token: its shape first, then what tells shapes never seen apart."""
    digits = re.sub("[^0-9]", "", token)
    out = [f"shape {shape(token)}", "any", f"digits {min(len(digits), 20) // 2}", f"dots {min(token.count('.'), 4)}", f"dashes {min(token.count('-'), 3)}"]
    out += [name for name, has in (("at", "@" in token), ("plus", token.startswith("+")), ("bracket", "(" in token), ("letter", bool(re.search(r"[^\W\d_]", token)))) if has]
    out += ["four parts"] if four_parts(token) else []
    out += ["check digit"] if 14 <= len(digits) <= 19 and luhn(digits) else []
    return tuple(out)


def tokens(text: str, spans: list) -> tuple[list, list]:
    """Spans of the nodes, trimmed of full stops, and their labels by pattern (0: none)."""
    where = []
    for m in TOKEN.finditer(text) if re.search("[0-9@]", text) else ():
        start, end = m.span()
        while end > start and text[end - 1] in ".":
            end -= 1
        where.append((start, end))
    labels, order, low = [0] * len(where), sorted((a, b, kind) for kind, a, b in spans), 0
    for i, (start, end) in enumerate(where):
        while low < len(order) and order[low][1] <= start:
            low += 1
        labels[i] = next((kind + 1 for a, b, kind in order[low : low + 4] if a < end and start < b), 0)
    return where, labels


def key(token: str) -> str:
    digits = re.sub("[^0-9]", "", token)
    return digits[-7:] if len(digits) >= 7 else token.lower()


@dataclass
class Weights:
    """Rows of `unary` by feature, log potentials by label pair, and the features' rows. Nothing was seen without a labelled token."""

    rows: dict
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    seen: bool = True

    def score(self, token: str) -> np.ndarray:
        """Log potentials of a token's labels. Shapes never seen are thought to be something else."""
        said = features(token)
        out = self.unary[[self.rows[f] for f in said if f in self.rows]].sum(0)
        return out if said[0] in self.rows else out + UNSEEN


UNSEEN = np.array([3.0] + [0.0] * len(KINDS))


def examples(texts: list[str], gap: int) -> Counter:
    """How often a token's features, the labels before and after it, and those of linked mentions, together and apart, go with its label."""
    n, out = len(KINDS) + 1, Counter()
    for text in texts:
        where, labels = tokens(text, find(text))
        groups = defaultdict(list)
        for i, (a, b) in enumerate(where):
            groups[key(text[a:b])].append(i)
        hidden = {i for g in groups.values() if any(labels[i] for i in g) for i in g if not labels[i]}
        linked = defaultdict(lambda: [0] * n)
        for group in groups.values():
            for i, j in zip(group, group[1:]):
                if not {i, j} & hidden:
                    linked[i][labels[j]] += 1
                    linked[j][labels[i]] += 1
        near = [i > 0 and where[i][0] - where[i - 1][1] <= gap for i in range(len(where))] + [False]
        for i, (a, b) in enumerate(where):
            if i not in hidden:
                before = labels[i - 1] if near[i] and i - 1 not in hidden else -1
                after = labels[i + 1] if near[i + 1] and i + 1 not in hidden else -1
                said, links = features(text[a:b]), tuple(linked[i])
                out[said, before, after, links, labels[i]] += 1
                # Evidence is also taken by itself, so that none leaves it to the others to explain a label.
                out[said, -1, -1, (0,) * n, labels[i]] += 1
                if any(links):
                    out[("any",), -1, -1, links, labels[i]] += 1
    return out


def fit(texts: list[str], gap: int = 2, least: int = 3, steps: int = 400, same: float = 3.0, precision: float = 0.02) -> Weights:
    """Maximises the pseudo-likelihood by gradient ascent, with steps that adapt to each weight. The prior's mean is `same` for the skip weight, else 0, its precision `precision`."""
    n, counted = len(KINDS) + 1, examples(texts, gap)
    often = Counter()
    for (said, *_), k in counted.items():
        often.update({f: k for f in said})
    rows = {f: i for i, f in enumerate(sorted(f for f, k in often.items() if k >= least))}
    if not any(y for *_, y in counted):
        return Weights(rows, np.zeros((len(rows), n)), np.zeros((n, n)), np.zeros((n, n)), False)
    x = np.zeros((len(counted), len(rows)), np.float32)
    before, after, linked, label_, count = (np.zeros((len(counted), n), np.float32) for _ in range(5))
    for r, ((said, b, a, links, y), k) in enumerate(sorted(counted.items())):
        x[r, [rows[f] for f in said if f in rows]] = 1
        if b >= 0:
            before[r, b] = 1
        if a >= 0:
            after[r, a] = 1
        linked[r], label_[r, y], count[r] = links, 1, k
    unary, chain, skip = np.zeros((len(rows), n)), np.zeros((n, n)), np.full(1, same)
    memory = [[np.zeros_like(w), np.zeros_like(w)] for w in (unary, chain, skip)]
    for step in range(1, steps + 1):
        score = x @ unary + before @ chain + after @ chain.T + skip * linked
        p = np.exp(score - score.max(1, keepdims=True))
        off = count * (label_ - p / p.sum(1, keepdims=True))
        slopes = (x.T @ off - precision * unary, before.T @ off + (after.T @ off).T - precision * chain, np.array([(linked * off).sum()]) - precision * (skip - same))
        for w, slope, m in zip((unary, chain, skip), slopes, memory):
            m[0], m[1] = 0.9 * m[0] + 0.1 * slope, 0.99 * m[1] + 0.01 * slope**2
            w += 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
    return Weights(rows, unary, chain, np.diag(np.full(n, max(0.0, float(skip[0])))))


def believe(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int) -> np.ndarray:
    """Beliefs by loopy sum-product passing; edges (from, to) with a log potential each, by (label of from, label of to)."""
    if len(edges):
        m = len(edges)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        potential = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message = np.zeros((2 * m, unary.shape[1]))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", out, potential) + 1e-30)
            message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        unary = unary.copy()
        np.add.at(unary, target, message)
    out = np.exp(unary - unary.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def hub_potential(skip: np.ndarray) -> np.ndarray:
    """The potential of links to a hub such that two of them together are as strong as one skip link."""
    n, e = len(skip), np.exp(skip[0, 0])
    return np.diag(np.full(n, np.log(e + np.sqrt(max(0.0, e * e + e * (n - 2) - (n - 1))))))


def mentions(groups: dict, labels: list) -> tuple[list, list]:
    """Links within groups of mentions, each in order: to the next and the nearest found ones; and the groups in which no pattern found any."""
    links, hubs = [], []
    for group in groups.values():
        found = [i for i in group if labels[i]]
        if not found:
            hubs += [group] if len(group) > 1 else []
            continue
        k, some = 0, set(zip(group, group[1:]))
        for i in group:
            while k < len(found) and found[k] <= i:
                k += 1
            if not labels[i]:
                some |= {(min(i, f), max(i, f)) for f in found[max(0, k - 1) : k + 1]}
        links += sorted(some)
    return links, hubs


def label(texts: list[str], weights: Weights, rules: PiiRules, base: list | None = None) -> list[list]:
    """Spans (kind, start, end, base) of each text. base: what patterns found, if it isn't to be sought."""
    n = len(KINDS) + 1
    base = [find(t) for t in texts] if base is None else base
    unary, edges, kinds, nodes, hubs = [], [], [], [], []
    for d, text in enumerate(texts if weights.seen else ()):
        where, labels = tokens(text, base[d])
        first, groups = len(nodes), defaultdict(list)
        for i, ((a, b), y) in enumerate(zip(where, labels)):
            nodes.append((d, a, b, y))
            unary.append(weights.score(text[a:b]) if not y else np.where(np.arange(n) == y, 0.0, -30.0))
            if i and a - where[i - 1][1] <= rules.gap:
                edges.append((first + i - 1, first + i))
                kinds.append(0)
            groups[key(text[a:b])].append(i)
        links, shared = mentions(groups, labels)
        edges += [(first + i, first + f) for i, f in links]
        kinds += [1] * len(links)
        hubs += [[first + i for i in group] for group in shared]
    for group in hubs:  # hubs follow the nodes of all texts
        edges += [(len(unary), me) for me in group]
        kinds += [2] * len(group)
        unary.append(np.zeros(n))
    spans = [[(k, a, b, True) for k, a, b in x] for x in base]
    if nodes:
        pair = np.stack([weights.chain, weights.skip, hub_potential(weights.skip)])[np.array(kinds, int)] if edges else np.zeros((0, n, n))
        belief = believe(np.array(unary), np.array(edges, int).reshape(-1, 2), pair, rules.rounds)
        best, sure, run = belief.argmax(1), belief.max(1), None
        runs = []
        for (d, a, b, y), z, p in zip(nodes, best.tolist(), sure.tolist()):
            new = z if not y and z and p >= rules.belief else 0
            if new and run and run[0] == d and run[1] == new and a - run[3] <= rules.gap and new != 1:
                run[3] = b
            elif new:
                runs.append(run := [d, new, a, b])
            else:
                run = None
        for d, z, a, b in runs:
            if plausible(z - 1, texts[d][a:b]):
                spans[d].append((z - 1, a, b, False))
    return [sorted(x, key=lambda s: (s[1], s[0], s[2])) for x in spans]


def train(docs: DataFrame, rules: PiiRules = PiiRules()) -> Weights:
    """Weights from the sample. Different texts are counted first, so that tasks send the driver few more than the sample holds."""
    some = docs.filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= rules.sample_chars)).select("text", F.xxhash64("text").alias("h"))
    share = min(1.0, 2 * rules.sample_docs / max(1, some.agg(F.approx_count_distinct("h")).first()[0]))
    below = some.filter(F.col("h") <= int(-(2**63) + share * (2**64 - 1025))) if share < 1 else some
    different = below.groupBy("h").agg(F.min("text").alias("text"))  # copies are dropped in the tasks that read them
    return fit([r[0] for r in different.orderBy("h").limit(rules.sample_docs).select("text").collect()], rules.gap)


def mark(docs: DataFrame, rules: PiiRules = PiiRules(), weights: Weights | None = None) -> DataFrame:
    """docs with `pii`: kind, start, end and whether a pattern gave the span."""
    mine = Aside(docs, ["pii"])
    weights = weights or train(mine.df.select(mine.col("text").alias("text")), rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def found(texts: pa.Array) -> pa.Array:
        rows = label([t or "" for t in texts.to_pylist()], weights, rules)
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in x] for x in rows], kind)

    return mine.back(mine.df, F.arrow_udf(tidy(found), "array<struct<kind:string,start:int,end:int,base:boolean>>")(mine.col("text")).alias("pii"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(mark(table(spark, sf_dir, "documents").select("doc_id", "text")), "pii", KINDS)
