"""Requests to a reasoning provider: the outbound gate, the two-call analysis, live runs and reports."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.hashing import request_fingerprint
from gneiss.functions.text import tokens
from gneiss.operators import live, outbound

#: Words in a variable's name that mark its value as a secret, and values that never are.
SECRET_WORDS = ["SECRET", "TOKEN", "PASSWORD", "PASSWD", "API_KEY", "APIKEY", "ACCESS_KEY", "PRIVATE_KEY", "CONNECTION_STRING"]
HARMLESS = ["true", "false", "yes", "no", "on", "off", "none", "null", "development", "production", "staging", "test", "local", "localhost", "changeme", "placeholder", "example", "dummy"]
SECRET_LENGTH = 8

#: Codes and messages that a failed call may show.
FAILURES = {"timeout": "The provider did not answer in time.", "rejected": "The provider rejected the request.", "malformed": "The provider's answer does not have the agreed form.", "unavailable": "The provider cannot be reached."}


def known_secrets(environment: Mapping[str, str | None]) -> frozenset[str]:
    """Values that must not leave: variables named like secrets, long enough and no common literal."""
    found = set()
    for name, value in environment.items():
        parts = "_" + name.upper().replace("-", "_") + "_"
        text = (value or "").strip()
        if len(text) >= SECRET_LENGTH and text.lower() not in HARMLESS and any(f"_{w}_" in parts for w in SECRET_WORDS):
            found.add(text)
    return frozenset(found)


@dataclass(frozen=True)
class Request:
    stage: str
    model: str
    system: str
    user: str
    output_tokens: int = 4_000

    def fingerprint(self, spark: SparkSession) -> str:
        row = spark.createDataFrame([(self.stage, self.model, self.system, self.user, str(self.output_tokens))], "a string, b string, c string, d string, e string")
        return row.select(request_fingerprint(*[F.col(c) for c in "abcde"]).alias("f")).first().f


@dataclass(frozen=True)
class Assessment:
    kind: str
    outcome: str
    policies: tuple[str, ...] = ()
    fingerprint: str | None = None


class Blocked(RuntimeError):
    def __init__(self, assessment: Assessment):
        super().__init__("blocked by " + ", ".join(assessment.policies))
        self.assessment = assessment


class Gate:
    """Only a request that was approved exactly as it is may be sent; any error while inspecting blocks."""

    def __init__(self, spark: SparkSession, secrets: frozenset[str] = frozenset()):
        self.spark, self.secrets = spark, secrets

    def assess(self, request: Request, kind: str = "Projected") -> Assessment:
        rows = self.spark.createDataFrame([("r", request.system + "\n" + request.user)], "request_id string, text string")
        try:
            row = outbound.assess(rows, outbound.inspect(rows, secrets=sorted(self.secrets))).first()
        except Exception:  # fails closed: what cannot be inspected is not sent
            return Assessment(kind, "Blocked", ("UNKNOWN",))
        if row.outcome != "Allowed":
            return Assessment(kind, "Blocked", tuple(row.blocked_policies))
        return Assessment(kind, "Allowed", (), request.fingerprint(self.spark))

    def approve(self, request: Request) -> tuple[Request, Assessment]:
        assessment = self.assess(request, "Exact")
        if assessment.outcome != "Allowed":
            raise Blocked(assessment)
        return request, assessment

    def send(self, provider: Callable[[Request], dict], request: Request, approved: Assessment) -> dict:
        """Send only what was approved: a projected assessment, or another fingerprint, is refused."""
        if approved.kind != "Exact" or approved.outcome != "Allowed" or approved.fingerprint != request.fingerprint(self.spark):
            raise Blocked(replace(approved, outcome="Blocked", policies=("INTEGRITY",)))
        return provider(request)


def failure(error: Exception) -> tuple[str, str]:
    """Code and message of a failed call; nothing of the error's own text goes on."""
    code = "timeout" if isinstance(error, TimeoutError) else "rejected" if isinstance(error, PermissionError) else "malformed" if isinstance(error, (ValueError, KeyError, TypeError)) else "unavailable"
    return code, FAILURES[code]


def interpret(initiatives: DataFrame, text: str = "text") -> DataFrame:
    """Deterministic understanding of initiatives: their terms are both capabilities and search terms."""
    terms = tokens(F.col(text))
    return initiatives.select("query_id", F.col(text).alias("summary"), terms.alias("technical_capabilities"), terms.alias("search_terms"))


@dataclass
class Analysis:
    understanding: dict
    recommendations: list[dict]
    usage: dict[str, int] = field(default_factory=dict)


def analyse(gate: Gate, provider: Callable[[Request], dict], initiative: str, retrieve: Callable[[dict], str], model: str = "model") -> Analysis:
    """Two calls: understand the initiative, then reason over the context that retrieval builds from it."""
    first = Request("Understanding", model, "Read the initiative.", initiative)
    one = gate.send(provider, *gate.approve(first))
    second = Request("Analysis", model, "Reason over the evidence.", retrieve(one["understanding"]), 6_000)
    two = gate.send(provider, *gate.approve(second))
    usage = {k: one.get("usage", {}).get(k, 0) + two.get("usage", {}).get(k, 0) for k in {*one.get("usage", {}), *two.get("usage", {})}}
    return Analysis(one["understanding"], two["recommendations"], usage)


def preview(gate: Gate, initiative: str, context: str, model: str = "model") -> dict:
    """Metadata of what would be sent: the first call exactly, the second as projected; no content."""
    one, two = gate.assess(Request("Understanding", model, "Read the initiative.", initiative), "Exact"), gate.assess(Request("Analysis", model, "Reason over the evidence.", context, 6_000))
    return {"schemaVersion": 2, "call1": one.__dict__, "call2": two.__dict__, "allowed": one.outcome == two.outcome == "Allowed"}


def load_assessment(artifact: str) -> dict:
    """An artifact's assessment; one from before assessments were kept counts as NotRecorded, never as allowed."""
    return json.loads(artifact).get("assessment") or {"outcome": "NotRecorded"}


def run_live(cases: list[dict], runs: int, provider: Callable[[dict, int], dict], save: Callable[[dict], None]) -> list[dict]:
    """Every case as often as asked, within the limits; each result is saved at once, failures as their code."""
    live.plan(len(cases), runs)
    results = []
    for run in range(1, runs + 1):
        for case in cases:
            try:
                row = {"case": case["id"], "run": run, "status": "Completed", "result": provider(case, run)}
            except Blocked as e:
                row = {"case": case["id"], "run": run, "status": "SecurityBlocked", "policies": list(e.assessment.policies)}
            except Exception as e:  # any failure is a status of its case, and the run goes on
                row = {"case": case["id"], "run": run, "status": "ProviderFailed", "code": failure(e)[0]}
            results.append(row)
            save(row)
    return results


def review(results: list[dict]) -> str:
    """Markdown table of a live run; cell contents on one line."""
    cell = lambda v: re.sub(r"[\x00-\x1f|]", " ", str(v))[:96]
    rows = [f"| {cell(r['case'])} | {r['run']} | {cell(r['status'])} |" for r in results]
    return "\n".join(["| case | run | status |", "|---|---|---|", *rows])


class FakeProvider:
    """Answers from fixtures, the same for the same request; it counts its calls and needs no network."""

    def __init__(self, understanding: dict, recommendations: list[dict]):
        self.understanding, self.recommendations, self.calls = understanding, recommendations, []

    def __call__(self, request: Request) -> dict:
        self.calls.append(request.stage)
        usage = {"input": -(-len(request.system + request.user) // 4), "output": 0}
        if request.stage == "Understanding":
            return {"understanding": self.understanding, "usage": usage}
        return {"recommendations": self.recommendations, "usage": usage}


def govern(analysis: Analysis, validate: Callable[[list[dict]], list[str]], comply: Callable[[list[dict]], list[list[str]]]) -> list[dict]:
    """Recommendations with their validation status and disposition: rejected where a blocking policy is violated, else for review unless validated."""
    out = []
    for row, status, policies in zip(analysis.recommendations, validate(analysis.recommendations), comply(analysis.recommendations)):
        disposition = "Rejected" if "Violated" in policies else "Accepted" if status == "Validated" and "Unknown" not in policies else "NeedsReview"
        out.append(row | {"status": status, "disposition": disposition})
    return out
