"""Prices, prompts, sampling, and the JSON of model requests and answers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: USD for a million tokens, in and out.
PRICES: dict[str, tuple[float, float]] = {
    "deepseek-ai/DeepSeek-OCR-v2": (0.10, 0.30),
    "deepseek-ai/DeepSeek-OCR-v2:free": (0.0, 0.0),
    "qwen/qwen3-vl-instruct": (0.20, 0.60),
    "qwen/qwen3-vl-instruct:free": (0.0, 0.0),
    "Qwen/Qwen3-VL-Instruct": (0.20, 0.60),
    "gemini-2.0-flash": (0.075, 0.30),
    "mock-model": (0.0, 0.0),
}
#: Tokens that a page is planned with, and the flat price a page of the serverless backend.
PLANNED_TOKENS = (800, 1200)
MODAL_PAGE_USD = 0.0005
PROMPT = "Transcribe this page into Markdown. Keep headings, paragraphs, lists and tables, with tables as Markdown tables. Leave nothing out, add nothing, and answer with the Markdown alone."
QWEN_SUFFIX = " Start with the page's own first words, without a sentence that introduces it."


def estimate_cost(model: str, prompt_tokens: int, completion_tokens: int) -> float:
    """USD of one call; 0.0 for a model without a price."""
    usd_in, usd_out = PRICES.get(model, (0.0, 0.0))
    return prompt_tokens / 1e6 * usd_in + completion_tokens / 1e6 * usd_out


def is_priced(model: str) -> bool:
    return model in PRICES


def page_estimate(model: str, pages: int = 1, backend: str = "") -> float:
    """Planned USD of some pages."""
    if backend in ("mock", "modal"):
        return {"mock": 0.0, "modal": MODAL_PAGE_USD}[backend] * pages
    return pages * estimate_cost(model, *PLANNED_TOKENS)


def price_table(spark: SparkSession) -> DataFrame:
    """model, usd_in, usd_out: one row a priced model."""
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, usd_in double, usd_out double")


def with_cost(df: DataFrame, prices: DataFrame | None = None, model: str = "model", prompt: str = "prompt_tokens", completion: str = "completion_tokens", strict: bool = False) -> DataFrame:
    """Adds cost_usd by a join with a price table of models; without a price 0.0, or null if `strict`.

    The built-in table is broadcast (a row a model of PRICES); a table of the caller's, whose size isn't known, is joined as Spark sees fit."""
    named = F.broadcast(price_table(df.sparkSession)) if prices is None else prices
    joined = df.join(named.withColumnRenamed("model", "_priced"), F.col(model) == F.col("_priced"), "left")
    cost = F.col(prompt) / 1e6 * F.col("usd_in") + F.col(completion) / 1e6 * F.col("usd_out")
    return joined.withColumn("cost_usd", cost if strict else F.coalesce(cost, F.lit(0.0))).drop("_priced", "usd_in", "usd_out")


#: Exact costs: USD with twelve decimals. Whole tokens at prices of up to six decimals a million have no more.
EXACT = "decimal(31,12)"


def exact_price_table(spark: SparkSession) -> DataFrame:
    """model, usd_in, usd_out as decimals."""
    rows = [(m, *(Decimal(str(x)) for x in p)) for m, p in PRICES.items()]
    return spark.createDataFrame(rows, "model string, usd_in decimal(12,6), usd_out decimal(12,6)")


def with_exact_cost(df: DataFrame, prices: DataFrame | None = None, model: str = "model", prompt: str = "prompt_tokens", completion: str = "completion_tokens", strict: bool = False) -> DataFrame:
    """Like with_cost, in decimals: sums don't hang on the order in which tasks end, so a cap is kept or broken the same way in every run.

    `prices` of the caller's may hold decimals or doubles; doubles are taken as their shortest text."""
    named = F.broadcast(exact_price_table(df.sparkSession)) if prices is None else prices
    of = lambda c: F.col(c).cast("string").cast("decimal(12,6)")
    named = named.select(F.col("model").alias("_priced"), of("usd_in").alias("_in"), of("usd_out").alias("_out"))
    joined = df.join(named, F.col(model) == F.col("_priced"), "left")
    part = lambda tokens, price: (F.col(tokens).cast("decimal(10,0)") * F.col(price) * F.lit(Decimal("0.000001"))).cast(EXACT)
    cost = (part(prompt, "_in") + part(completion, "_out")).cast(EXACT)
    return joined.withColumn("cost_usd", cost if strict else F.coalesce(cost, F.lit(0).cast(EXACT))).drop("_priced", "_in", "_out")


def money(x: Column | str) -> Column:
    """$ and four decimals."""
    return F.format_string("$%.4f", x)


def prompt_for(model: str, override: str | None = None) -> str:
    return override or PROMPT + (QWEN_SUFFIX if "qwen" in model.lower() else "")


def prompt_column(model: Column | str, override: Column | str | None = None) -> Column:
    m = F.col(model) if isinstance(model, str) else model
    default = F.when(F.contains(F.lower(m), F.lit("qwen")), F.lit(PROMPT + QWEN_SUFFIX)).otherwise(F.lit(PROMPT))
    if override is None:
        return default
    o = F.col(override) if isinstance(override, str) else override
    return F.when(F.coalesce(o, F.lit("")) != "", o).otherwise(default)


#: Temperature, max_tokens and top_p by model, and those of every other model.
SAMPLING: dict[str, tuple[float, int, float]] = {
    "deepseek-ai/DeepSeek-OCR-v2": (0.0, 4096, 1.0),
    "deepseek-ai/DeepSeek-OCR-v2:free": (0.0, 4096, 1.0),
    "qwen/qwen3-vl-instruct": (0.0, 4096, 0.95),
    "qwen/qwen3-vl-instruct:free": (0.0, 4096, 0.95),
    "Qwen/Qwen3-VL-Instruct": (0.0, 4096, 0.95),
}
DEFAULT_SAMPLING = (0.0, 4096, 1.0)


def sampling_for(model: str) -> dict[str, float]:
    temperature, max_tokens, top_p = SAMPLING.get(model, DEFAULT_SAMPLING)
    return {"temperature": temperature, "max_tokens": max_tokens, "top_p": top_p}


def sampling_column(model: Column | str) -> Column:
    """struct<temperature, max_tokens, top_p> of a column of models."""
    m = F.col(model) if isinstance(model, str) else model
    shown = lambda s: F.struct(F.lit(s[0]).alias("temperature"), F.lit(s[1]).alias("max_tokens"), F.lit(s[2]).alias("top_p"))
    named = F.create_map(*(x for k, s in SAMPLING.items() for x in (F.lit(k), shown(s))))
    return F.coalesce(F.try_element_at(named, m), shown(DEFAULT_SAMPLING))


def chat_request(model: str, prompt: str, image_uri: str) -> dict:
    """Body of a chat completion with one text and one image."""
    parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": image_uri}}]
    return {"model": model, "messages": [{"role": "user", "content": parts}], **sampling_for(model)}


def chat_request_column(model: Column, prompt: Column, uri: Column) -> Column:
    """The same body as a JSON column."""
    text = F.struct(F.lit("text").alias("type"), prompt.alias("text"))
    image = F.struct(F.lit("image_url").alias("type"), F.struct(uri.alias("url")).alias("image_url"))
    content = F.concat(F.lit("["), F.to_json(text), F.lit(","), F.to_json(image), F.lit("]"))
    sampling = sampling_column(model)
    head = F.to_json(F.struct(model.alias("model"), *(sampling[k].alias(k) for k in ("temperature", "max_tokens", "top_p"))))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"messages":[{"role":"user","content":'), content, F.lit("}]}"))


def chat_answer(body: Column | str) -> Column:
    """struct<content, prompt_tokens, completion_tokens, error> of a stored chat completion body."""
    b = F.col(body) if isinstance(body, str) else body
    content = F.get_json_object(b, "$.choices[0].message.content")
    soft = F.get_json_object(b, "$.error").isNotNull() & F.get_json_object(b, "$.choices").isNull()
    error = F.when(soft, F.concat(F.lit("rate_limit: "), F.left(F.get_json_object(b, "$.error"), F.lit(120)))).when(content.isNull(), F.lit("parse: no content"))
    tokens = [F.coalesce(F.get_json_object(b, f"$.usage.{k}").cast("int"), F.lit(0)).alias(k) for k in ("prompt_tokens", "completion_tokens")]
    return F.struct(content.alias("content"), *tokens, error.alias("error"))


def gemini_answer(body: Column | str) -> Column:
    """The same of a generateContent body."""
    b = F.col(body) if isinstance(body, str) else body
    content = F.get_json_object(b, "$.candidates[0].content.parts[0].text")
    tokens = [F.coalesce(F.get_json_object(b, f"$.usageMetadata.{k}").cast("int"), F.lit(0)).alias(a) for k, a in (("promptTokenCount", "prompt_tokens"), ("candidatesTokenCount", "completion_tokens"))]
    return F.struct(content.alias("content"), *tokens, F.when(content.isNull(), F.lit("parse: no content")).alias("error"))


def error_kind(error: Column | str) -> Column:
    """none, auth, rate_limit, http, parse or exception."""
    e = F.col(error) if isinstance(error, str) else error
    return (
        F.when(e.isNull() | (e == ""), F.lit("none"))
        .when(e == "missing API key", F.lit("auth"))
        .when(e.startswith("rate_limit:"), F.lit("rate_limit"))
        .when(e.rlike("^http [0-9]+:"), F.lit("http"))
        .when(e.startswith("parse:"), F.lit("parse"))
        .otherwise(F.lit("exception"))
    )
