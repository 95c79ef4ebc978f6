"""Secret scans: all rules in one deterministic automaton, one pass over the bytes of a text.

The forward automaton (any text, then the beginning of any rule) is run once over a text and tells where
matches of a rule begin to count. From there the backward automaton of that rule finds where the
match starts, and its anchored automaton how far it goes. Matches of a rule are leftmost, longest and do
not overlap; those below the rule's least length are dropped after they have consumed their text. Time is
linear in the text: a stretch that one run has read in vain stops later runs that come there in the same state.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.automata import compiled
from plumbline.llm.common import documents, packed, share, unpacked, with_text_columns


NOTED = 32                    # bytes read in vain from which on a run is remembered


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``lead`` then ``body``. A match counts if its body (``of_body``) or the whole match
    has ``least`` characters or more."""

    kind: str
    lead: str
    body: str
    least: int = 1
    of_body: bool = False


#: The base kinds, in the order in which ties of position are listed (fixed values).
BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=\-]+", 8, True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16),
    Rule("hex", r"", r"[0-9a-f]+", 32),
)

#: Further kinds of well-known shapes.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", r"[A-Za-z0-9+/=\x20\n\r]*", 27),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9\-]+", 15),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 30),
    Rule("google", r"AIza", r"[A-Za-z0-9_\-]+", 39),
)


@dataclass
class Scanner:
    """The compiled rules: flat transition lists, states multiplied by 256."""

    rules: tuple[Rule, ...]
    forward: list[int]
    accepts: dict[int, list[int]]
    onward: list[tuple[list[int], set[int]]] = field(default_factory=list)
    backward: list[tuple[list[int], set[int]]] = field(default_factory=list)
    bodies: list[tuple[list[int], set[int]]] = field(default_factory=list)


def flat(table: np.ndarray, accepted: np.ndarray) -> tuple[list[int], set[int]]:
    return (table.astype(np.int64) * 256).ravel().tolist(), {int(s) * 256 for s in np.flatnonzero(accepted)}


def trigger(rule: Rule) -> str:
    """What the one pass looks for: the lead and the first body character, or, without a lead, as many
    body characters as the rule asks for. Leaving the rest of the body out keeps the automaton small."""
    one_class = rule.body.startswith("[") and rule.body.endswith("]+") and rule.body.count("]") == 1
    if rule.lead:
        return rule.lead + rule.body[:-1] if one_class else rule.lead
    return f"{rule.body[:-1]}{{{rule.least}}}" if one_class else rule.body


def compile_rules(rules=BASE + MORE) -> Scanner:
    table, accepted = compiled([trigger(r) for r in rules], search=True)
    scanner = Scanner(tuple(rules), flat(table, accepted)[0], {
        int(s) * 256: [r for r in range(len(rules)) if int(accepted[s]) >> r & 1] for s in np.flatnonzero(accepted)})
    for rule in rules:
        scanner.onward.append(flat(*compiled([rule.lead + rule.body])))
        scanner.backward.append(flat(*compiled([trigger(rule)], backward=True)))
        scanner.bodies.append(flat(*compiled([rule.lead])) if rule.lead else ([], set()))
    return scanner


def longest(data: bytes, start: int, automaton: tuple[list[int], set[int]], dead: array | None = None) -> int:
    """End of the longest match that begins at ``start``, or -1.

    ``dead`` remembers, by place, states from which an earlier run found no further end. A run that comes to one of
    them stops, so that starts within one long stretch do not each read it to its end."""
    table, accepts = automaton
    state, end, at = 256, start if 256 in accepts else -1, start
    for at in range(start, len(data)):
        state = table[state + data[at]]
        if not state:
            break
        if state in accepts:
            end = at + 1
        elif dead is not None and dead[at] == state:
            break
    if dead is not None and at - max(start, end) >= NOTED:
        state = 256
        for place in range(start, at):
            state = table[state + data[place]]
            if place >= end:
                dead[place] = state
    return end


def leftmost(data: bytes, end: int, floor: int, automaton: tuple[list[int], set[int]]) -> int:
    """The smallest start, at ``floor`` or later, of a match that ends at ``end``; -1 if there is none."""
    table, accepts = automaton
    state, start = 256, -1
    for at in range(end - 1, floor - 1, -1):
        state = table[state + data[at]]
        if not state:
            break
        if state in accepts:
            start = at
    return start


def scan(data: bytes, scanner: Scanner) -> list[tuple[int, int, int]]:
    """(start, end, rule) in bytes of all matches that count, by start and rule."""
    rules, forward, accepts = scanner.rules, scanner.forward, scanner.accepts
    done, out, dead = [0] * len(rules), [], {}
    state = 256
    for at, byte in enumerate(data, 1):
        state = forward[state + byte]
        if state in accepts:
            for rule in accepts[state]:
                if at <= done[rule]:
                    continue
                start = leftmost(data, at, done[rule], scanner.backward[rule])
                if start < 0:
                    continue
                if trigger(rules[rule]) == rules[rule].lead and rule not in dead:
                    dead[rule] = array("l", bytes(8 * len(data)))
                end = longest(data, start, scanner.onward[rule], dead.get(rule))
                if end < 0:
                    continue
                done[rule], size = end, end - start
                if rules[rule].of_body:
                    size = end - longest(data, start, scanner.bodies[rule])
                if size >= rules[rule].least:
                    out.append((start, end, rule))
    return sorted(out)


def with_secrets(df: DataFrame, rules=BASE + MORE, *, text_col: str = "text", clean: bool = False) -> DataFrame:
    """``df`` with ``secret_kinds``, ``secret_starts`` and ``secret_ends`` (code points, end exclusive), by start
    and then in the order of ``rules``. Null and empty texts have none. With ``clean`` also ``redacted``, the texts
    with every span replaced by ``[KIND]``."""
    shared = share(df.sparkSession, compile_rules(rules))

    def make():
        scanner = shared.value

        def columns(texts):
            kinds, starts, ends = [], [], []
            for text in texts:
                text = text or ""
                data = text.encode()
                found = scan(data, scanner)
                if len(data) == len(text):
                    place = int
                else:
                    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                    place = lambda at, points=points: int(points[at - 1]) if at else 0
                kinds.append([scanner.rules[r].kind for _, _, r in found])
                starts.append([place(a) for a, _, _ in found])
                ends.append([place(b) for _, b, _ in found])
            out = {"secret_kinds": kinds, "secret_starts": starts, "secret_ends": ends}
            if clean:
                out["redacted"] = [redacted(t, *s) if s[0] else t for t, *s in zip(texts, kinds, starts, ends)]
            return out

        return columns

    added = "secret_kinds array<string>, secret_starts array<long>, secret_ends array<long>" + ", redacted string" * clean
    return with_text_columns(df, make, added, text_col)


def query(spark, sf_dir):
    """op9: scan every document; base kinds counted and digested, all spans listed."""
    found = with_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.transform(F.arrays_zip("secret_kinds", "secret_starts", "secret_ends"), lambda s: F.struct(
        s["secret_kinds"].alias("kind"),
        F.concat_ws(":", s["secret_kinds"], s["secret_starts"].cast("string"), s["secret_ends"].cast("string")).alias("text")))

    def listed(array):
        return F.concat_ws(",", F.transform(array, lambda s: s["text"]))

    def count(kind):
        return F.size(F.filter("secret_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("all_spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return found.withColumn("all_spans", spans).select(
        "doc_id", *(count(r.kind) for r in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed("all_spans").alias("spans"))


def redacted(text: str, kinds, starts, ends) -> str:
    """``text`` with every span replaced by ``[KIND]``; of overlapping spans the first names the whole."""
    out, at = [], 0
    for kind, start, end in zip(kinds, starts, ends):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in the texts. No document goes; ``n_chars`` follows the new text."""
    found = with_secrets(packed(docs), clean=True).withColumn("text", F.col("redacted"))
    return unpacked(found, docs, n_chars=F.when(F.size("secret_kinds") > 0, F.length("text")).otherwise(F.col("other.n_chars")))
