"""JSON texts as one canonical text each: names in order, no blanks, secrets left out at any depth."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of parameters that never enter a key.
SECRETS = ("api_key", "access_token", "authorization", "auth_token", "hf_token", "password", "secret", "token")


def strict(text: str):
    """The value of a JSON text; names that an object has twice, and numbers that JSON lacks, are refused."""

    def once(pairs: list[tuple]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("an object has a name twice")
        return out

    def no(name: str):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=once, parse_constant=no)


def safe(value):
    """Without what secret names hold, at any depth."""
    if isinstance(value, dict):
        return {k: safe(v) for k, v in value.items() if k.lower() not in SECRETS}
    return [safe(v) for v in value] if isinstance(value, list) else value


def canonical_text(text: str | None, secrets: bool = False) -> str | None:
    if text is None:
        return None
    value = strict(text)
    return json.dumps(value if secrets else safe(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical(text: Column, secrets: bool = False) -> Column:
    """The canonical text on Arrow batches; null stays null, what is not strict JSON fails. ``secrets`` keeps them."""

    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: canonical_text(x, secrets))

    return F.pandas_udf(run, "string")(text)


def refused(text: Column) -> Column:
    """Why a text is no strict JSON; null if it is one or is null."""

    def why(x):
        try:
            return x if x is None else (strict(x), None)[1]
        except (ValueError, RecursionError) as e:
            return str(e) or "too deep"

    def run(t: pd.Series) -> pd.Series:
        return t.map(why).astype(object)

    return F.pandas_udf(run, "string")(text)


def payload_key(payload: Column, model: Column, params: Column) -> Column:
    """The digest under which an answer to a JSON payload is kept: its content, the model and its safe parameters."""
    content = F.sha2(canonical(payload, True), 256)
    whole = F.concat(F.lit('{"content_sha256":"'), content, F.lit('","kind":"payload","model":'), canonical(F.to_json(F.array(model)), True), F.lit(',"params":'), canonical(params), F.lit("}"))
    return F.sha2(F.regexp_replace(whole, r'"model":\[(.*?)\],"params":', '"model":$1,"params":'), 256)
