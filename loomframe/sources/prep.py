"""Dataset preparation: rows in canonical schemas, splits, message building, masks and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def message(role, content) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def rl_row(source: str, messages: Column, ability: str, truth: Column, split: str, index: Column, style: str = "rule", **extra: Column) -> list[Column]:
    """The columns of a prompt row."""
    info = F.struct(F.lit(split).alias("split"), index.alias("index"), *[c.alias(k) for k, c in extra.items()])
    return [
        F.lit(source).alias("data_source"),
        messages.alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        info.alias("extra_info"),
    ]


def numeric_solution(answer: Column) -> Column:
    """The number after "#### ", without commas."""
    return F.regexp_replace(F.regexp_extract(answer, r"#### (\-?[0-9\.\,]+)", 1), ",", "")


def tool_row(system: str, question: Column, tools: dict[str, Column]) -> list[Column]:
    """System and user prompt, and create arguments per tool."""
    kwargs = F.struct(*[F.struct(F.struct(v.alias("ground_truth")).alias("create_kwargs")).alias(k) for k, v in tools.items()])
    return [F.array(message("system", F.lit(system)), message("user", question)).alias("prompt"), kwargs.alias("tools_kwargs")]


def tagged_truth(df: DataFrame, prefix: str) -> DataFrame:
    """Source names with a prefix, and the truth from the reward model or else the golden answers."""
    return df.withColumn("data_source", F.concat(F.lit(prefix), F.col("data_source"))).withColumn("ground_truth", F.coalesce("reward_ground_truth", "golden_answers"))


def pairs_to_rows(df: DataFrame) -> DataFrame:
    """Two rows (prompt, response) of each preference pair, the chosen one first."""
    return df.select("row_idx", "prompt", F.posexplode(F.array("chosen", "rejected")).alias("_k", "response")).select((F.col("row_idx") * 2 + F.col("_k")).alias("row_idx"), "prompt", "response")


def head_split(df: DataFrame, share: float, n: int) -> DataFrame:
    """Adds split: train for the first `share` of positions, else test."""
    return df.withColumn("split", F.when(F.col("row_idx") < int(n * share), "train").otherwise("test"))


def random_split(df: DataFrame, share: float, key: str, seed: int = 0) -> DataFrame:
    """Adds split by a keyed hash, the same on any partitioning."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumn("split", F.when(u < share, "test").otherwise("train"))


def equal_splits(n: int, k: int) -> Column:
    if n == 0 or n % k:
        raise ValueError(f"{n} rows do not divide into {k} splits")
    return F.floor(F.col("row_idx") / (n // k)).cast("int")


def conversation_messages(turns: Column) -> Column:
    """{from, value} turns as {role, content}; an unknown speaker is an error."""
    role = lambda c: F.when(c["from"] == "human", "user").when(c["from"] == "gpt", "assistant").when(c["from"] == "system", "system").otherwise(F.raise_error(F.concat(F.lit("unknown speaker "), c["from"])).cast("string"))
    return F.transform(turns, lambda c: message(role(c), c["value"]))


def question_answer_messages(question: Column, answer: Column) -> Column:
    return F.array(message("user", question), message("assistant", answer))


def labelled_only(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.length(label) > 0)


def media_segments(content: Column, images: Column, videos: Column | None = None) -> Column:
    """Typed segments of text with <image> and <video> placeholders, the k-th bound to the k-th of its kind; counts must agree."""
    media = {"image": images} | ({"video": videos} if videos is not None else {})
    parts = F.filter(F.split(F.regexp_replace(content, f"(<(?:{'|'.join(media)})>)", "\u0001$1\u0001"), "\u0001"), lambda s: s != "")
    count = lambda of, mark: F.size(F.filter(of, lambda x: x == mark))

    def bound(s: Column, i: Column) -> Column:
        out = F.struct(F.lit("text").alias("type"), s.alias("value"))
        for kind, values in media.items():
            out = F.when(s == f"<{kind}>", F.struct(F.lit(kind).alias("type"), F.try_element_at(values, count(F.slice(parts, 1, i + 1), f"<{kind}>")).alias("value"))).otherwise(out)
        return out

    agree = F.lit(True)
    for kind, values in media.items():
        agree = agree & (count(parts, f"<{kind}>") == F.size(values))
    return F.when(agree, F.transform(parts, bound)).otherwise(F.raise_error(F.lit("placeholders and media differ in number")))


def with_defaults(df: DataFrame) -> DataFrame:
    """index, tools_kwargs and interaction_kwargs lifted from extra_info with their defaults, and dataset_idx."""
    fields = {f.name for f in df.schema["extra_info"].dataType.fields}
    pick = lambda name, kind, default: F.coalesce(F.col(f"extra_info.{name}").cast(kind), default) if name in fields else default
    empty = F.lit("{}")
    return df.withColumn("index", pick("index", "long", F.lit(0).cast("long"))).withColumn("tools_kwargs", pick("tools_kwargs", "string", empty)).withColumn("interaction_kwargs", pick("interaction_kwargs", "string", empty)).withColumn("dataset_idx", F.col("row_idx"))


def loss_mask(tokens: Column, role: Column) -> Column:
    """1 for tokens of assistant turns."""
    return F.transform(tokens, lambda _: F.when(role == "assistant", 1).otherwise(0))


def whole_conversation(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, tokens, loss_mask: turns joined in order, from (conv, turn, role, tokens)."""
    d = df.withColumn("_m", loss_mask(F.col("tokens"), F.col("role")))
    g = d.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "tokens", "_m"))).alias("_t"))
    return g.select(conv, F.flatten(F.col("_t.tokens")).alias("tokens"), F.flatten(F.col("_t._m")).alias("loss_mask"))


def preference_pair(df: DataFrame, most: int, eos: int, pad: int = 0) -> DataFrame:
    """ids and mask of (chosen, rejected): prompt and answer ids ended by eos, padded or cut on the right."""

    def one(answer: str) -> Column:
        ids = F.concat(F.col("prompt_ids"), F.col(answer))
        ids = F.when(F.element_at(ids, -1) == eos, ids).otherwise(F.array_append(ids, F.lit(eos)))
        return F.struct(A.fit_length(ids, most, pad, left_pad=False, truncation="right").alias("ids"), A.fit_length(F.transform(ids, lambda _: F.lit(1)), most, 0, left_pad=False, truncation="right").alias("mask"))

    return df.withColumn("pair", F.array(one("chosen_ids"), one("rejected_ids")))


def response_slice(mask: str = "attention_mask", responses: str = "responses") -> Column:
    """The last response-length entries."""
    return F.slice(mask, -F.size(responses), F.size(responses))


def padded_response(values: Column, prompt_n: Column, response_n: Column, width: int) -> Column:
    """The response part of ragged model output, read one token early, padded on the right."""
    return A.pad(F.slice(values, prompt_n, response_n), width, 0.0)


def without_ids(ids: Column, drop: list[int], width: int, pad: int) -> Column:
    """Some ids removed and the rest padded on the left again."""
    return A.pad(F.filter(ids, lambda x: ~x.isin(drop)), width, pad, left=True)


def chat_text(messages: Column) -> Column:
    """Messages in one string by a plain template."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"], F.lit("\n"))), "")


def sample_conversations(spark, n: int = 4) -> DataFrame:
    """A small synthetic table of conversations, fixed by n."""
    i = F.col("id").cast("string")
    turns = F.array(message("system", F.lit("You are helpful.")), message("user", F.concat(F.lit("What is "), i, F.lit(" + 1?"))), message("assistant", (F.col("id") + 1).cast("string")))
    return spark.range(n).select(F.col("id").alias("row_idx"), turns.alias("messages"))


def packed_to_multiple(df: DataFrame, tokens: str, multiple: int, pad: int = 0) -> DataFrame:
    """One more row of padding so that all tokens together divide by `multiple`; none if they do."""
    n = df.agg(F.coalesce(F.sum(F.size(tokens)), F.lit(0)).alias("_n"), F.coalesce(F.max("row_idx") + 1, F.lit(0)).alias("row_idx"))
    more = n.select(F.col("row_idx").cast(dict(df.dtypes)["row_idx"]).alias("row_idx"), F.pmod(-F.col("_n"), F.lit(multiple)).cast("int").alias("_more")).where("_more > 0")
    extra = more.select("row_idx", F.array_repeat(F.lit(pad), F.col("_more")).cast(dict(df.dtypes)[tokens]).alias(tokens))
    return df.select("row_idx", tokens).unionByName(extra)


def rollout_row(prompt: str, response: str, prompt_width: int, response_width: int, pad: int = 0, response_mask: str | None = None) -> list[Column]:
    """prompts (padded left), responses (padded right), their masks, joined ids and positions.

    A response beyond its width stays whole: in the joined columns it takes the room of the prompt's padding, so that they keep their width
    of prompt_width + response_width while the tokens fit in.
    """
    p, q = A.pad(prompt, prompt_width, pad, left=True), A.pad(response, response_width, pad)
    pm = A.pad(F.transform(prompt, lambda _: F.lit(1)), prompt_width, 0, left=True)
    qm = A.pad(F.transform(response, lambda _: F.lit(1)), response_width, 0)
    rm = F.zip_with(A.pad(response_mask, response_width, 0), qm, lambda a, b: a * b) if response_mask else qm
    taken = F.least(F.greatest(F.size(q) - F.lit(response_width), F.lit(0)), F.size(p) - F.size(prompt))
    joined = lambda a, b: F.slice(F.concat(a, b), taken + 1, F.size(a) + F.size(b))
    mask = joined(pm, qm)
    return [p.alias("prompts"), q.alias("responses"), rm.alias("response_mask"), joined(p, q).alias("input_ids"), mask.alias("attention_mask"), A.position_ids(F.transform(mask, lambda x: x.cast("double"))).alias("position_ids")]
