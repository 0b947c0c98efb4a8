"""Dialog functions: prompts, history, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lexicon as L
from .text import _text


def _turn(template: str, role: Column, text: Column) -> Column:
    """A turn of a user or an assistant as the template has it; other roles are empty."""
    t = L.PROMPTS[template]
    return F.when(role == "user", F.concat(F.lit(t["user"]), text, F.lit(t["user_end"]))).when(role == "assistant", F.concat(F.lit(t["assistant"]), text, F.lit(t["assistant_end"]))).otherwise("")


def _end(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def prompts(turns: DataFrame, template: str = "chatml", system: str = "", thinking: bool = False) -> DataFrame:
    """EN3: conv_id, prompt: the turns before the last user turn as history, that turn as the message. turns: conv_id, turn, role, text.

    The gemma template sets the system prompt into the first turn, if that is a user's.
    """
    t = L.PROMPTS[template]
    own = turns.select("conv_id", "turn", "role", _text("text").alias("text"))
    last = own.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    rows = own.join(last, "conv_id").filter("turn <= _last")
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    message = _end(F.element_at("h", -1)["text"])
    history = F.slice("h", F.lit(1), F.size("h") - 1)
    if template == "gemma":
        lead = F.lit(system + t["system_end"] if system else "")
        told = F.transform(history, lambda x, i: _turn(template, x["role"], F.when((i == 0) & (x["role"] == "user"), F.concat(lead, x["text"])).otherwise(x["text"])))
        message = F.when(F.size("h") == 1, F.concat(lead, message)).otherwise(message)
        head = F.lit("")
    else:
        told = F.transform(history, lambda x: _turn(template, x["role"], x["text"]))
        head = F.lit(t["system"] + system + t["system_end"])
    tail = F.lit(t["user_end"] + t["assistant"] + ("" if thinking else t["no_thinking"]))
    return conv.select("conv_id", F.concat(head, F.array_join(told, ""), F.lit(t["user"]), message, tail).alias("prompt"))


def trimmed(turns: DataFrame, template: str = "chatml", system: str = "", most: int = L.N_CTX - L.MAX_TOKENS - L.RESERVE, check: str = "[check]") -> DataFrame:
    """EN4: the turns that are left when the two oldest go until a quarter of the prompt's length is under `most`."""
    t = L.PROMPTS[template]
    fixed = len(t["system"] + system + t["system_end"] + t["user"] + check + t["user_end"] + t["assistant"] + t["no_thinking"])
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("_i", F.row_number().over(order) - 1).withColumn("_len", F.length(_turn(template, F.col("role"), _text("text"))))
    rest = F.sum("_len").over(W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_rest", rest)
    fits = (F.col("_i") % 2 == 0) & (F.floor((F.col("_rest") + fixed) / 4) < most)
    start = F.min(F.when(fits, F.col("_i"))).over(W.partitionBy("conv_id"))
    return rows.withColumn("_from", start).filter(F.col("_i") >= F.col("_from")).select(turns.columns)


def pieces(c, size: int = 4) -> Column:
    """EN5: the text in pieces of `size` characters."""
    c = _text(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(size)), lambda i: F.substring(c, i, F.lit(size))))


def chosen_number(answer, n, key: str = "match_number") -> Column:
    """EN2: the whole number under `key` in an answer's fenced JSON object, or else from its first brace to its last; null outside 1 to n. true counts as 1."""
    a = _text(answer)
    fenced = F.regexp_extract(a, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(a, r"(?s)(\{.*\})", 1))
    value = F.get_json_object(body, f"$.{key}")
    number = F.when(value == "true", 1).when(value.rlike(r"^-?\d{1,9}$"), value.try_cast("int"))
    return F.when((number >= 1) & (number <= n), number)
