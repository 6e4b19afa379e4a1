"""Chat formatting: roles of a plain transcript's lines by a hidden Markov model, then canonical turns."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

ROLES = ("system", "user", "assistant")
#: A state is a role and whether the line opens a turn: 2 * role + (0 opening, 1 going on).
STATES = 2 * len(ROLES)
#: Usual speaker names by role.
NAMES = {
    "system": ("system", "instructions", "context", "sys"),
    "user": ("user", "human", "question", "customer", "q", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "agent", "a", "model"),
}
_ROLE_OF = {n: i for i, r in enumerate(ROLES) for n in NAMES[r]}
#: A short name in optional brackets or signs, then a colon, a greater-than sign or a closing bracket.
_MARKER = re.compile(r"^\s{0,3}(?:[#*\[<(|]{0,3})\s?([A-Za-z][\w .-]{0,18}?)\s?(?:[*\]>)|]{0,3})\s?(?::|>|\]|\))\s?", re.ASCII)

#: Observations: a marker of a known name (from 0), and after those a marker of another name, a line after a blank one, any other.
OTHER_NAME, AFTER_BLANK, PLAIN = -3, -2, -1
LENGTHS, FORMS = 3, 2
#: Conversations that a model is fitted to at most, in the order of a hash; times that a name has to mark turns to be known.
SAMPLE, KNOWN = 2000, 5
#: Observations that the probabilities set by hand count for in each row of a fitted model.
PRIOR = 3.0


def _log(rows) -> np.ndarray:
    x = np.array(rows, float)
    return np.log(x / x.sum(axis=-1, keepdims=True))


#: First turns: mostly the user's, or a system's.
START = _log([[0.30, 0, 0.62, 0, 0.08, 0]] + 1e-9 * np.ones((1, STATES)))[0]


def _transitions() -> np.ndarray:
    """A turn goes on with another line or gives way: to the user after a system, to the other speaker after a user or an
    assistant, seldom to the same one."""
    turn = np.array([[0.01, 0.94, 0.05], [0.01, 0.06, 0.93], [0.02, 0.92, 0.06]])
    out = np.full((STATES, STATES), 1e-9)
    for r in range(len(ROLES)):
        for s in (2 * r, 2 * r + 1):
            out[s, 2 * r + 1] = 0.55
            out[s, 0::2] = 0.45 * turn[r]
    return _log(out)


def _emissions() -> dict[str, np.ndarray]:
    marker = np.full((STATES, len(ROLES) + 3), 1e-4)
    length, form = np.empty((STATES, LENGTHS)), np.empty((STATES, FORMS))
    for r in range(len(ROLES)):
        marker[2 * r, r] = 0.80
        marker[2 * r, [OTHER_NAME, AFTER_BLANK, PLAIN]] = 0.06, 0.12, 0.01
        marker[2 * r + 1, [OTHER_NAME, AFTER_BLANK, PLAIN]] = 0.01, 0.08, 0.90
        for s in (2 * r, 2 * r + 1):
            length[s] = ((0.2, 0.5, 0.3), (0.45, 0.40, 0.15), (0.25, 0.45, 0.30))[r]  # short, medium, long
            form[s] = ((0.98, 0.02), (0.75, 0.25), (0.95, 0.05))[r]  # statement, question
    return {"marker": _log(marker), "length": _log(length), "form": _log(form)}


class Model:
    """Known marker names and their symbols, and the logarithms of a hidden Markov model's probabilities."""

    def __init__(self, names: dict[str, int], start: np.ndarray, transition: np.ndarray, emission: dict[str, np.ndarray]):
        self.names, self.start, self.transition, self.emission = names, start, transition, emission


#: Without a sample: usual names, and probabilities set by hand.
USUAL = Model(_ROLE_OF, START, _transitions(), _emissions())


def fit(conversations: list[list[tuple[str, str]]]) -> Model:
    """A model counted from conversations whose turns are known, as (role, turn as it is written, with its marker if it has one).

    Names that mark turns KNOWN times are learnt as symbols of their own, whatever they are; the probabilities are the shares of
    starts, successions, markers, line lengths and forms in the sample, to which USUAL's count for PRIOR observations. Without
    turns: USUAL."""
    opened: Counter = Counter()
    lined = []
    for turns in conversations:
        lines, blank, states = [], [], []
        for role, text in turns:
            if role not in ROLES:
                continue
            gap, own = False, 0
            for line in text.split("\n"):
                if not line.strip():
                    gap = True
                    continue
                lines.append(line)
                blank.append(gap)
                states.append(2 * ROLES.index(role) + (own > 0))
                if not own and (m := _MARKER.match(line)):
                    opened[m[1].strip().lower()] += 1
                gap, own = False, own + 1
        if lines:
            lined.append((lines, blank, states))
    if not lined:
        return USUAL
    names = {n: i for i, n in enumerate(sorted(n for n, c in opened.items() if c >= KNOWN))}
    start, transition, *tables = (PRIOR * np.exp(x) for x in (USUAL.start, USUAL.transition, *USUAL.emission.values()))
    marks = np.concatenate([np.full((STATES, len(names)), 0.5), tables[0][:, OTHER_NAME:]], axis=1)
    emission = dict(zip(USUAL.emission, (marks, *tables[1:]), strict=True))
    for lines, blank, states in lined:
        seen, _ = observe(lines, blank, names)
        start[states[0]] += 1
        np.add.at(transition, (states[:-1], states[1:]), 1)
        for i, table in enumerate(emission.values()):
            np.add.at(table, (states, seen[:, i]), 1)
    return Model(names, _log(start), _log(transition), {k: _log(v) for k, v in emission.items()})


def observe(lines: list[str], blank_before: list[bool], names: dict[str, int] = _ROLE_OF) -> tuple[np.ndarray, list[str]]:
    """[line, (marker, length, form)] and the lines without their markers."""
    seen, texts = np.zeros((len(lines), 3), np.int64), []
    for i, (line, blank) in enumerate(zip(lines, blank_before, strict=True)):
        m = _MARKER.match(line)
        name = m[1].strip().lower() if m else None
        symbol = names.get(name) if name else None
        if symbol is not None:
            seen[i, 0], rest = symbol, line[m.end() :]
        elif m and (blank or i == 0) and len(name.split()) <= 2:
            seen[i, 0], rest = OTHER_NAME, line
        else:
            seen[i, 0], rest = (AFTER_BLANK if blank else PLAIN), line
        texts.append(rest)
        n = len(rest)
        seen[i, 1] = 0 if n < 60 else 1 if n < 400 else 2
        seen[i, 2] = rest.rstrip().endswith(("?", "？"))
    return seen, texts


def viterbi(seen: np.ndarray, model: Model = USUAL) -> np.ndarray:
    """The likeliest states; of equally likely ones the lowest."""
    n = len(seen)
    e = sum(table[:, seen[:, i]] for i, table in enumerate(model.emission.values()))
    back = np.zeros((n, STATES), np.int8)
    score = model.start + e[:, 0]
    for i in range(1, n):
        ways = score[:, None] + model.transition
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + e[:, i]
    out = np.empty(n, np.int64)
    out[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def parse(transcript: str | None, model: Model = USUAL) -> list[tuple[str, str]]:
    """(role, text) turns of a transcript. Blank lines within a turn are kept, those around it aren't."""
    return parse_lines(transcript, model)[0]


def parse_lines(transcript: str | None, model: Model = USUAL) -> tuple[list[tuple[str, str]], str]:
    """The turns, and the first letter of the role of each line that isn't blank."""
    lines, blank, gap = [], [], False
    gaps = []
    skipped = 0
    for line in (transcript or "").split("\n"):
        if not line.strip():
            gap, skipped = True, skipped + 1
            continue
        lines.append(line)
        blank.append(gap)
        gaps.append(skipped)
        gap, skipped = False, 0
    if not lines:
        return [], ""
    seen, texts = observe(lines, blank, model.names)
    states = viterbi(seen, model)
    turns: list[tuple[str, list[str]]] = []
    for s, text, empty in zip(states, texts, gaps, strict=True):
        role = ROLES[s // 2]
        if s % 2 and turns and turns[-1][0] == role:
            turns[-1][1].extend([""] * empty)
            turns[-1][1].append(text)
        else:
            turns.append((role, [text]))
    return [(r, "\n".join(x).strip()) for r, x in turns], "".join(ROLES[s // 2][0] for s in states)


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: a line with the role between bars, the text, and an end mark."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def format_transcripts(df: DataFrame, key: str, col: str = "transcript", keep_text: bool = False, model: Model = USUAL, truth: str | None = None) -> DataFrame:
    """Per transcript its recovered turns: key, n_turns, roles (joined by commas), rendered_sha256, with keep_text the canonical
    text, and with `truth`, a column that holds the first letter of the role of each line, the share of lines whose role is
    recovered (null without lines). No shuffle; a worker holds one transcript. Null and empty transcripts have no turns and the
    empty text; repeated rows give equal rows; an empty table none; other columns are not read."""

    def run(texts: list) -> dict:
        both = [parse_lines(t, model) for t in texts]
        full = [render(t) for t, _ in both]
        return {
            "n_turns": [len(t) for t, _ in both],
            "roles": [",".join(r for r, _ in t) for t, _ in both],
            "rendered_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in full],
            "rendered": full,
            "line_roles": [x for _, x in both],
        }

    schema = "n_turns long, roles string, rendered_sha256 string" + ", rendered string" * keep_text + ", line_roles string" * bool(truth)
    out = map_texts(df, lambda: run, schema, (key, truth) if truth else (key,), col)
    if not truth:
        return out
    same = F.filter(F.zip_with(F.split("line_roles", ""), F.split(truth, ""), lambda x, y: x == y), lambda x: F.coalesce(x, F.lit(False)))
    share = F.when(F.length(truth) > 0, F.round(F.size(same) / F.greatest(F.length(truth), F.length("line_roles")), 6))
    return out.withColumn("agreement", share).drop("line_roles", truth)


#: How a plain transcript may mark its speakers, by role; a conversation has one style. The last three have names that USUAL lacks.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "Instructions: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "[context] ", "user": "[q] ", "assistant": "[a] "},
    {"system": "**System**: ", "user": "**Customer**: ", "assistant": "**Agent**: "},
    {"system": "Setup> ", "user": "Caller> ", "assistant": "Desk> "},
    {"system": "[brief] ", "user": "[guest] ", "assistant": "[host] "},
    {"system": "Stage: ", "user": "Mia: ", "assistant": "Theo: "},
)


def plain_transcripts(turns: DataFrame, drop_every: int = 9) -> DataFrame:
    """(conv_id, transcript, true_lines, written) from (conv_id, turn, role, text): the turns in order in one of the plain styles;
    one in `drop_every` turns has lost its marker and only stands after a blank line. true_lines has the first letter of the
    role of each line that isn't blank, written the turns as (role, line). Turns without a conversation stand alone; null texts
    are empty, null roles the user's. Ties of turn go by role and text."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    role = F.coalesce("role", F.lit("user"))
    mark = F.lit("")
    for i, names in enumerate(STYLES):
        for r, name in names.items():
            mark = F.when((style == i) & (role == r), F.lit(name)).otherwise(mark)
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(drop_every)) == 0
    line = F.when(lost, F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.concat(mark, F.coalesce("text", F.lit(""))))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = turns.select("conv_id", alone.alias("alone"), F.struct("turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), line.alias("line")).alias("t"))
    got = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("t"))
    lines = F.transform("t", lambda x: F.repeat(F.substring(x["role"], 1, 1), F.size(F.filter(F.split(x["line"], "\n"), lambda y: F.length(F.trim(y)) > 0))))
    return got.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("transcript"),
        F.array_join(lines, "").alias("true_lines"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["line"].alias("line"))).alias("written"),
    )


def train(turns: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to at most `sample` conversations of (conv_id, turn, role, text), written in the plain styles."""
    ids = turns.where("conv_id is not null").select("conv_id").distinct().orderBy(F.xxhash64(F.lit(41), "conv_id"), "conv_id").limit(sample)
    # at most `sample` ids are broadcast, and as many conversations come to the driver
    own = plain_transcripts(turns.select("conv_id", "turn", "role", "text").join(F.broadcast(ids), "conv_id", "left_semi"))
    got = sorted((r["conv_id"], [(t["role"], t["line"]) for t in r["written"]]) for r in own.select("conv_id", "written").collect())
    return fit([t for _, t in got])
