"""Chat formatting: records of any known layout become canonical turns, and turns one marked string.

A record is JSON. The paths of its fields, with types of the leaves and arrays flattened, are hashed; the fingerprint
picks the declarative mapping that reads the turns. Marks of the template never occur inside a formatted text: a
backslash goes between the first two characters of each control string, so that taking the backslashes out again gives
the text back.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common chat templates, escaped when they stand inside a text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_PIECE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
# Role names of other layouts, by canonical role; our own layout keeps roles as they are.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where turns stand: a list of (role, text) under `turns`, or fixed fields with their roles.

    An optional field that is empty is no turn; a field with the role of the one before it continues that turn.
    """

    turns: str | None = None
    role: str = "role"
    text: str = "text"
    fields: tuple[tuple[str, str, bool], ...] = ()

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.turns is not None:
            said = [(x.get(self.role) or "", x.get(self.text) or "") for x in record.get(self.turns) or [] if x is not None]
            return said if self.turns == "turns" else [(ROLES.get(r, r), t) for r, t in said]
        out: list[tuple[str, str]] = []
        for name, role, optional in self.fields:
            said = record.get(name)
            if said is None or optional and not said:
                continue
            if out and out[-1][0] == role:  # instruction and input are one user turn
                out[-1] = (role, out[-1][1] + "\n\n" + said)
            else:
                out.append((role, said))
        return out


def paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves with their types; elements of a list share '[]', nulls and missing fields look alike."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return set() if value is None else {f"{at}:{'text' if isinstance(value, str) else 'other'}"}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


#: Fields that say nothing of the turns, whatever is in them.
ASIDE = ("id", "conv_id", "source", "lang", "meta", "metadata", "category")


def _layouts() -> dict[str, Mapping]:
    """Fingerprints of the known layouts, each with and without its optional fields."""
    known: dict[str, Mapping] = {}
    for turns, role, text in (("messages", "role", "content"), ("messages", "role", "text"), ("conversations", "from", "value"), ("turns", "role", "text"), ("conversation", "role", "content"), ("dialog", "speaker", "text")):
        m = Mapping(turns, role, text)
        both = {f"{turns}[].{role}:text", f"{turns}[].{text}:text"}
        for found in (both, *({x} for x in both), {f"{turns}[]"}, both | {f"{turns}[]"}):
            known[fingerprint(found)] = m
    for ask, answer in (("instruction", "output"), ("instruction", "response"), ("prompt", "completion"), ("prompt", "response"), ("question", "answer"), ("prompt", "chosen"), ("query", "response"), ("input", "output")):
        for more in ((), ("input",), ("system",), ("system", "input"), ("context",), ("rejected",)):
            fields = [("system", "system", True)] * ("system" in more) + [(ask, "user", False)] + [(x, "user", True) for x in more if x in ("input", "context") and x != ask] + [(answer, "assistant", False)]
            known.setdefault(fingerprint({f"{x}:text" for x in (ask, answer, *more)}), Mapping(fields=tuple(fields)))
    return known


LAYOUTS = _layouts()


def layout_of(value: object) -> str | None:
    """The fingerprint of a known layout that the record has, with or without the fields that stand aside."""
    if not isinstance(value, dict):
        return None
    for found in (paths(value), paths({k: v for k, v in value.items() if k not in ASIDE})):
        if fingerprint(found) in LAYOUTS:
            return fingerprint(found)
    return None


def parsed(record: str | None) -> tuple[str | None, list[tuple[str, str]] | None]:
    """Layout and turns of a JSON record; (None, None) for broken JSON and layouts nobody knows.

    A layout is known by the paths of its leaves and by their being texts, so no record of a known one can be misread.
    """
    try:
        value = json.loads(record or "")
        layout = layout_of(value)
    except (ValueError, RecursionError):
        return None, None
    return layout, LAYOUTS[layout].read(value) if layout else None


def canonical(record: str | None) -> list[tuple[str, str]] | None:
    """The turns of a JSON record, or None if its layout is unknown. Field names of no layout are left out of it."""
    return parsed(record)[1]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\)?", lambda m: "\\" if m[1] else "", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of it that carry loss: the texts of assistant turns."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _PIECE.findall(formatted)]


def records_of(rows: DataFrame, mixed: bool = False) -> DataFrame:
    """rows (conv_id, turn, role, text, ...) -> conv_id, record: one JSON record per conversation, its turns in order of
    turn (nulls first), then role and text; a null conv_id is one conversation, a null text or role empty.

    All have the layout `turns`; with mixed, the layout changes with conv_id among those that can hold the conversation
    without loss, as records from several collections would have them.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    own = F.to_json(F.struct("turns"))
    if not mixed:
        return told.select("conv_id", own.alias("record"))
    roles = F.transform("turns", lambda x: x["role"])
    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    ask, answer = (F.get("turns", F.lit(i))["text"] for i in (0, 1))
    shared = F.transform("turns", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    messages = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    kind = F.pmod(F.col("conv_id"), F.lit(5))
    record = (
        F.when(pair & (kind == 0), F.to_json(F.struct(ask.alias("instruction"), F.lit("").alias("input"), answer.alias("output"))))
        .when(pair & (kind == 1), F.to_json(F.struct(ask.alias("prompt"), answer.alias("completion"))))
        .when(plain & kind.isin(0, 2), F.to_json(F.struct(F.col("conv_id").alias("id"), shared.alias("conversations"))))
        .when(plain & kind.isin(1, 3), F.to_json(F.struct(messages.alias("messages"))))
        .otherwise(own)
    )
    return told.select("conv_id", record.alias("record"))


FORMATTED = "conv_id long, layout string, n_turns long, formatted string, mask array<struct<start:long,end:long>>"


def format_chats(records: DataFrame) -> DataFrame:
    """records (conv_id, record) -> conv_id, layout (fingerprint), n_turns, formatted, mask; one row per row.

    Unknown layouts, broken JSON and nulls give null layout, n_turns, formatted and mask; a record without turns gives
    an empty text. Repeated rows give repeated results, an empty table none, and other columns, whatever their names, are
    left out. Texts of any length are formatted whole; one record is in memory at a time besides its Arrow batch. Offsets
    of the mask are code points.
    """

    def run(frames):
        for frame in frames:
            out = []
            for conv, record in zip(frame["conv_id"], frame["record"], strict=True):
                layout, turns = parsed(record)
                if turns is None:
                    out.append((conv, None, None, None, None))
                    continue
                text, mask = format_turns(turns)
                out.append((conv, layout, len(turns), text, [{"start": a, "end": b} for a, b in mask]))
            f = pd.DataFrame(out, columns=["conv_id", "layout", "n_turns", "formatted", "mask"])
            f["conv_id"], f["n_turns"] = f["conv_id"].astype("Int64"), f["n_turns"].astype("Int64")
            yield f

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), "record").mapInPandas(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: turns, and the text under the mask, unescaped.

    One row per row; rows that were not formatted have nulls.
    """

    def run(frames):
        for frame in frames:
            out = []
            for conv, text, mask in zip(frame["conv_id"], frame["formatted"], frame["mask"], strict=True):
                if text is None:
                    out.append((conv, *[None] * 5))
                    continue
                turns = read_back(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(told.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            f = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            for c in ("conv_id", "n_turns", "loss_chars", "formatted_chars"):
                f[c] = f[c].astype("Int64")
            yield f

    return chats.select("conv_id", "formatted", "mask").mapInPandas(run, DIGEST)
