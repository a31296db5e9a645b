"""Prompts: demonstration blocks, evidence blocks and templates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.config import RARE
from spanlens.functions.text import join_tokens, span

SENTENCE, EXAMPLES, ENTITY = "{{input_sentence}}", "{{icl_examples}}", "{{predicted_entities}}"
TEMPLATES = {
    "icl_json": f"Find all entities of the types {{{{types}}}} in the input. Answer with a JSON object that lists name and type of each under \"named entities\".\n\n{EXAMPLES}\n\nInput: {SENTENCE}\nOutput:",
    "icl_tagging": f"Repeat the input and mark each entity of the types {{{{types}}}} as [ name | type ].\n\n{EXAMPLES}\n\nInput: {SENTENCE}\nOutput:",
    "icl_code": f"Complete the code so that entity_list holds each entity of the types {{{{types}}}}.\n\n{EXAMPLES}\n\ninput_text = \"{SENTENCE}\"\n",
    "reflect_unseen": f"Some tokens may belong to entities that were missed. Weigh the evidence for each and give the final list under \"named entities\".\n\n{EXAMPLES}\n\nInput: {SENTENCE}\nPredicted: {ENTITY}\nOutput:",
    "reflect_fn": f"Some tokens are mostly part of entities but were missed. Weigh the evidence for each and give the final list under \"named entities\".\n\n{EXAMPLES}\n\nInput: {SENTENCE}\nPredicted: {ENTITY}\nOutput:",
    "reflect_boundary": f"Check the boundary of the predicted entity with the evidence for its tokens. Answer with the updated entity as a JSON object, or {{}} to delete it.\n\n{EXAMPLES}\n\nInput: {SENTENCE}\nPredicted: {ENTITY}\nOutput:",
}


def json_entities(ents) -> str:
    """Entities as JSON with Python's spacing and ASCII escapes."""
    return json.dumps({"named entities": [{"name": x["name"], "type": x["type"]} for x in ents]})


def tagged(tokens: list[str], ents) -> str:
    """The sentence with its entities marked; spans that don't match their name stay plain."""
    out, at = [], 0
    for x in sorted(ents, key=lambda x: x["s"]):
        if x["s"] >= at and " ".join(tokens[x["s"] : x["e"] + 1]) == x["name"]:
            out += [*tokens[at : x["s"]], f"[ {x['name']} | {x['type']} ]"]
            at = x["e"] + 1
    return " ".join([*out, *tokens[at:]])


def _marked(tokens: Column, ents: Column) -> Column:
    """``tagged`` of entities in order, as a native column: long texts stay in the JVM."""
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        s, e = x["s"].cast("int"), x["e"].cast("int")
        before = F.when(F.least(s, F.size(tokens)) > done["at"], F.array(join_tokens(F.slice(tokens, done["at"] + 1, s - done["at"])))).otherwise(none)
        mark = F.concat(F.lit("[ "), x["name"], F.lit(" | "), x["type"], F.lit(" ]"))
        fits = (s >= done["at"]) & (join_tokens(span(tokens, s, e)) == x["name"])
        return F.when(fits, F.struct(F.concat(done["parts"], before, F.array(mark)).alias("parts"), (e + 1).alias("at"))).otherwise(done)

    def rest(done: Column) -> Column:
        left = F.size(tokens) - done["at"]
        return F.array_join(F.concat(done["parts"], F.when(left > 0, F.array(join_tokens(F.slice(tokens, done["at"] + 1, left)))).otherwise(none)), " ")

    found = F.aggregate(ents, F.struct(none.alias("parts"), F.lit(0).alias("at")), step, rest)
    return F.when(ents.isNull(), join_tokens(tokens)).otherwise(found)


def block(template: str, tokens: Column, sentence: Column, ents: Column) -> Column:
    """One demonstration; ents are in the order of their start. JSON's ASCII escapes are a UDF over the entities."""
    if template == "icl_code":
        line = lambda x: F.concat(F.lit('\nentity_list.append({"text": "'), x["name"], F.lit('", "type": "'), x["type"], F.lit('"})'))
        return F.concat(F.lit('input_text = "'), sentence, F.lit('"\nentity_list = []'), F.coalesce(F.array_join(F.transform(ents, line), ""), F.lit("")))

    @F.pandas_udf("string")
    def listed(ents: pd.Series) -> pd.Series:
        return pd.Series([json_entities([] if e is None else e) for e in ents])

    return F.concat(F.lit("Input: "), sentence, F.lit("\nOutput: "), _marked(tokens, ents) if template == "icl_tagging" else listed(ents))


def filled(template: str, types, sentence: Column, examples: Column, predicted: Column | None = None, guide: str = "") -> Column:
    """The template with the task's guide, the sentence, then examples (so braces in examples stay) put in."""
    body = TEMPLATES[template].replace("{{types}}", ", ".join(types))
    body = body.replace(f"\n\n{EXAMPLES}", f"\n{guide}\n\n{EXAMPLES}", 1) if guide else body
    out = F.replace(F.lit(body), F.lit(SENTENCE), sentence)
    if predicted is not None:
        out = F.replace(out, F.lit(ENTITY), predicted)
    return F.replace(out, F.lit(EXAMPLES), examples)


def icl_prompts(queries: DataFrame, demos: DataFrame, retrieved: DataFrame, template: str, types, guide: str = "") -> DataFrame:
    """(id, icl_example_ids, icl_prompt): the k blocks of each query, best last, in its template.

    demos(id, tokens, sentence, ents); retrieved(qid, rank, did).
    """
    near = retrieved.select("qid", "rank", "did").persist()
    shown = demos.join(F.broadcast(near.select(F.col("did").alias("id")).distinct()), "id", "left_semi")  # texts of other demos stay where they are
    blocks = shown.select(F.col("id").alias("did"), block(template, F.col("tokens"), F.col("sentence"), F.col("ents")).alias("block"))
    met = blocks.join(F.broadcast(near), "did")
    rows = met.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("turn"), "did", "block"))).alias("rows"))
    out = queries.join(rows, queries.id == rows.qid)
    return out.select("id", F.col("rows.did").alias("icl_example_ids"), filled(template, types, F.col("sentence"), F.array_join("rows.block", "\n\n"), guide=guide).alias("icl_prompt"))


def _repr(values) -> str:
    return str([str(v) for v in values])


def _examples(rows) -> str:
    out = []
    for r in rows:
        answer = {"name": r["ent_span"], "type": r["ent_type"]} if r["ent_span"] else {}
        out.append(f"Input: {r['cxt']}\nOutput: {json.dumps(answer)}")
    return "\n\n".join(dict.fromkeys(out))


#: Headings of the evidence: of all tokens, and of one, by kind; and of an unseen token's neighbours, by role.
HEADS = {"unseen": ("Tokens in question", "Token in question"), "fn": ("Tokens left out", "Token left out"), "boundary": ("Tokens at the edges", "Token at the edge")}
NEAR = {"entity": "Neighbours that are often part of entities", "context": "Neighbours that often stand beside entities"}
SEEN = {"entity": "Seen as part of an entity", "context": "Seen beside an entity", "other": "Seen elsewhere"}


def evidence_text(kind: str, tokens: list[dict]) -> str:
    """The evidence block of one sentence (or entity).

    tokens: dicts with token, stats (counts or None), status (boundary only), and examples: lists of occurrences by role
    (fn, boundary) or by (role, neighbour) (unseen).
    """
    every, one = HEADS[kind]
    parts = [f"{every}: {_repr(t['token'] for t in tokens)}"]
    for t in tokens:
        text = f"## {one}: {t['token']}"
        if kind == "boundary":
            text += f"\nWhere it stands: {t['status']}"
        if kind == "unseen":
            for role, heading in NEAR.items():
                near = [(x["neighbour"], x["rows"]) for x in t["examples"] if x["role"] == role]
                if near:
                    text += f"\n{heading}: {_repr(n for n, _ in near)}"
                    text += "".join(f"\n### {n}\n{_examples(rows)}" for n, rows in near)
        elif t["stats"] is None or (kind == "boundary" and sum(t["stats"]) < RARE):
            text += "\nThe labelled sentences hold it hardly or not at all, so there are no examples."
        else:
            counts, by = dict(zip(SEEN, t["stats"], strict=True)), {x["role"]: x["rows"] for x in t["examples"]}
            text += "".join(f"\n{heading}, {counts[role]} of {sum(t['stats'])} times:\n{_examples(by.get(role, []))}" for role, heading in SEEN.items())
        parts.append(text)
    return "\n\n".join(parts)


def _evidence_udf(kind: str):
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for tokens in rows:
            items = []
            for t in tokens:
                stats = None if t["n_ent"] is None or pd.isna(t["n_ent"]) else (int(t["n_ent"]), int(t["n_ctx"]), int(t["n_oth"]))
                items.append({"token": t["token"], "stats": stats, "status": t["status"], "examples": list(t["examples"]) if t["examples"] is not None else []})
            out.append(evidence_text(kind, items))
        return pd.Series(out)

    return run


def evidence(kind: str, tokens: DataFrame, stats: DataFrame, labelled: DataFrame, sents: DataFrame, k: int, width: int, neighbours: DataFrame | None = None) -> DataFrame:
    """(key, evidence): one block for each key of tokens(key, id, pos, token, status).

    labelled(id, tokens, ents) are the sentences that examples come from. Examples are the k occurrences of the token (of its evidence neighbours, for unseen ones) by role whose context
    shares most with the token's surroundings. neighbours(id, pos, neighbour, role) names them.
    """
    from spanlens.functions.text import window
    from spanlens.operators.examples import best_examples, with_texts

    pos = F.col("pos").cast("int")
    placed = tokens.join(sents.select("id", "tokens"), "id").select("key", "id", "pos", "token", "status", join_tokens(window(F.col("tokens"), pos, pos, width)).alias("span")).persist()
    spot = F.struct("key", "pos")
    if kind == "unseen":
        wanted = placed.join(neighbours, ["id", "pos"]).select(spot.alias("key"), F.col("neighbour").alias("token"), "role", "span").distinct()
    else:
        roles = F.explode(F.array(*map(F.lit, ("entity", "context", "other"))))
        wanted = placed.select(spot.alias("key"), "token", roles.alias("role"), "span")
    top = with_texts(best_examples(wanted, labelled, k, width), labelled, width)
    rows = top.groupBy("key", "token", "role").agg(F.array_sort(F.collect_list(F.struct("rank", "ent_span", "ent_type", "cxt"))).alias("rows"))
    by = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("token").alias("neighbour"), "role", "rows"))).alias("examples"))
    joined = placed.join(by.select(F.col("key.key").alias("key"), F.col("key.pos").alias("pos"), "examples"), ["key", "pos"], "left").join(stats.select("token", "n_ent", "n_ctx", "n_oth"), "token", "left")
    packed = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "status", "n_ent", "n_ctx", "n_oth", "examples"))).alias("tokens"))
    return packed.select("key", _evidence_udf(kind)("tokens").alias("evidence"))
