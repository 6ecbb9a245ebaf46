"""Model calls behind providers, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions.lexicon import python_terms
from ragloom.sources.workers import ship_code

#: Texts of a call that embeds, names of one that decides, names of one that groups; calls at once
#: in a task.
EMBED_BATCH, RESOLVE_BATCH, GROUP_BATCH, AT_ONCE = 64, 60, 2000, 4


def hashed_vectors(texts: list[str], dim: int = 256) -> list[list[float]]:
    """Signed hashes of a text's terms, of length one; no terms give zeros."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for term in python_terms(text):
            h = int.from_bytes(hashlib.sha1(term.encode()).digest()[:8], "little")
            out[i, h % dim] += 1 if h >> 63 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms == 0, 1, norms)).astype(np.float32).tolist()


def title_rules(names: list[str]) -> list[dict]:
    """Names without a leading title, as decisions."""
    title = re.compile(r"^(?:King|Queen|Prince|Princess|Lord|Lady|Ser|Maester|Khal)\s+(?=[A-Z]\S*\s+[A-Z])")
    return [{"surface": n, "canonical": title.sub("", n), "type": None, "keep": True} for n in names]


def extractive_answer(question: str, evidence: list[str]) -> str:
    """The best evidence as the answer."""
    return evidence[0] if evidence else "What was found holds no answer."


def overlap_scores(question: str, answer: str, evidence: list[str]) -> dict[str, int]:
    """Rubric scores by term overlap of the answer with question and evidence."""
    terms, said, shown = (set(python_terms(x)) for x in (question, answer, " ".join(evidence)))
    grade = lambda part: 2 if part >= 0.5 else 1 if part > 0 else 0
    near, held = len(terms & said) / max(1, len(terms)), len(said & shown) / max(1, len(said))
    return {"relevance": grade(near), "constraint_handling": grade(near), "evidence_grounding": grade(held), "reasoning_transparency": 2 if evidence else 0, "hallucination_resistance": grade(held)}


def overlap_judgement(question: str, shown: dict[str, dict]) -> dict:
    """Scores of every system by what it shows, and which has the highest sum."""
    texts = lambda d: [str(v) for k in d if k != "answer" for x in (d[k] if isinstance(d[k], list) else [d[k]]) for v in (x.values() if isinstance(x, dict) else [x])]
    scores = {system: overlap_scores(question, d["answer"], texts(d)) for system, d in shown.items()}
    best = max(scores, key=lambda system: sum(scores[system].values()))
    return {**scores, "verdict": f"{best} covers most of the question with what it shows."}


def any_edges(question: str, schema: str, linked: list[dict], previous: dict | None) -> str:
    """The relationships of the first linked entity, or any."""
    if linked and not previous:
        name = linked[0]["name"].replace("\\", "\\\\").replace("'", "\\'")
        return f"MATCH (a {{name: '{name}'}})-[r]-(b) RETURN a.name, r, b.name LIMIT 10"
    return "MATCH (a)-[r]->(b) RETURN a.name, r, b.name LIMIT 10"


@dataclass(frozen=True)
class Providers:
    """Every model call; replace any with one that asks a service.

    ``query(question, schema, linked, previous)`` gets the linked entities' names and types,
    and after a failure the query and its error. ``groups(kind, names)`` gives groups
    ``{"canonical": name, "members": [names]}``. ``judge(question, shown)`` scores what
    ``evaluation.shown_to_judge`` lets it see, with a ``verdict``.
    """

    embed: Callable[[list[str]], list[list[float]]] = hashed_vectors
    extract: Callable[[str], str] = lambda text: '{"triples": []}'
    decide: Callable[[list[str]], list[dict]] = title_rules
    groups: Callable[[str, list[str]], list[dict]] = lambda kind, names: []
    mentions: Callable[[str], list[str]] = lambda question: re.findall(r"[A-Z][\w'’]*(?:\s+[A-Z][\w'’]*)*", question)
    query: Callable[[str, str, list[dict], dict | None], str] = any_edges
    answer: Callable[[str, list[str]], str] = extractive_answer
    judge: Callable[[str, dict[str, dict]], dict] = overlap_judgement
    settings: dict = field(default_factory=dict)


DEFAULT = Providers()


def completing(complete: Callable[..., str], base: Providers = DEFAULT) -> Providers:
    """Providers of which all but the embedding ask one completion service.

    ``complete(instructions, text, temperature=0.0, schema=None)`` gives a reply; where a
    schema is named the reply is JSON. Broken JSON gives nothing, except from a judge,
    whose reply must hold scores.
    """

    def parsed(reply: str, key: str) -> list:
        text = re.sub(r"^```[a-z]*\s*|\s*```$", "", reply.strip(), flags=re.IGNORECASE)
        try:
            found = json.loads(text)
        except ValueError:
            return []
        found = found.get(key, []) if isinstance(found, dict) else found
        return found if isinstance(found, list) else []

    def query(question: str, schema: str, linked: list[dict], previous: dict | None) -> str:
        known = "\n".join(f'- "{e["name"]}" ({e["type"]})' for e in linked) or "none"
        failed = f"\nThis query failed, mend it:\n{previous['query']}\n{previous['error']}" if previous else ""
        reply = complete(f"Write one read-only Cypher query over this graph and nothing else.\n{schema}", f"Entities:\n{known}\nQuestion: {question}{failed}")
        return re.sub(r"^```[a-z]*\s*|\s*```$", "", reply.strip(), flags=re.IGNORECASE)

    def judge(question: str, shown: dict[str, dict]) -> dict:
        text = json.dumps({"question": question, **shown}, ensure_ascii=False)
        return json.loads(complete("Score each system's answer by what is shown, 0 to 2 in each category, with a verdict.", text, schema="evaluation"))

    return replace(
        base,
        extract=lambda text: complete("List the facts of the text as triples, in JSON.", text, schema="triples"),
        decide=lambda names: parsed(complete("Give each name its canonical form and type.", "\n".join(names), schema="decisions"), "decisions"),
        groups=lambda kind, names: parsed(complete(f"Group the names of one {kind}.", "\n".join(names), schema="groups"), "groups"),
        mentions=lambda question: [str(m) for m in parsed(complete("List the names in the question.", question, schema="mentions"), "mentions")],
        query=query,
        answer=lambda question, evidence: complete("Answer by the evidence alone.", "\n\n".join([question, *evidence]), temperature=0.2),
        judge=judge,
    )


def pooled(call: Callable, items: list, most: int = AT_ONCE) -> list:
    """``call`` of every item in order, ``most`` at once; a failed one gives null."""

    def one(item):
        try:
            return call(item)
        except Exception:
            return None

    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(one, items))


def embed(rows: DataFrame, text_col: str, providers: Providers = DEFAULT, out: str = "embedding") -> DataFrame:
    """Adds the embedding of a text column; calls hold 64 texts, and the result doesn't depend on where they end."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part[text_col].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), EMBED_BATCH) for v in providers.embed(texts[i : i + EMBED_BATCH])]
            yield part.assign(**{out: vectors})

    ship_code(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, `{out}` array<float>")


def extract(chunks: DataFrame, providers: Providers = DEFAULT) -> DataFrame:
    """Adds ``reply``, the extraction of each chunk; a failed call gives null and so no triples."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(reply=pooled(providers.extract, part["text"].fillna("").tolist()))

    ship_code(chunks.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{fields}, reply string")


def decide(surfaces: DataFrame, providers: Providers = DEFAULT) -> DataFrame:
    """``surface, canonical, type, keep`` of each surface, 60 a call; a failed call decides nothing."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names = part["surface"].tolist()
            found = pooled(providers.decide, [names[i : i + RESOLVE_BATCH] for i in range(0, len(names), RESOLVE_BATCH)])
            yield pd.DataFrame([d for x in found for d in x or []], columns=["surface", "canonical", "type", "keep"])

    ship_code(surfaces.sparkSession)
    return surfaces.select("surface").mapInPandas(run, "surface string, canonical string, type string, keep boolean")


def groups(entities: DataFrame, providers: Providers = DEFAULT) -> DataFrame:
    """``a, b, canonical``: ids of entities of one type that a call puts into one group.

    A call holds a type's names, 2,000 at most; a type with more is dealt to calls by the
    last word of the name, which spellings of one name mostly share. Unknown members drop
    out; a failed call groups nothing.
    """
    sizes = entities.groupBy("type").agg(F.ceil(F.count("*") / GROUP_BATCH).alias("calls"))
    last = F.element_at(F.split(F.lower(F.trim("canonical_name")), r"\s+"), -1)
    dealt = entities.join(F.broadcast(sizes), "type").withColumn("call", F.pmod(F.xxhash64(last), "calls"))  # a row a type

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, out = rows.sort_values(["mentions", "id"], ascending=[False, True]), []
        for at in range(0, len(own), GROUP_BATCH):
            part = own.iloc[at : at + GROUP_BATCH]
            ids = dict(zip(part["canonical_name"].str.lower().str.strip(), part["id"], strict=True))
            found = pooled(lambda names: providers.groups(part["type"].iloc[0], names), [part["canonical_name"].tolist()])[0]
            for g in found or []:
                members = [i for i in dict.fromkeys(ids.get(str(m).lower().strip()) for m in g.get("members") or []) if i]
                out += [(members[0], m, g.get("canonical") or "") for m in members[1:]]
        return pd.DataFrame(out, columns=["a", "b", "canonical"]).astype(str)

    ship_code(entities.sparkSession)
    return dealt.select("type", "call", "id", "canonical_name", "mentions").groupBy("type", "call").applyInPandas(run, "a string, b string, canonical string")
