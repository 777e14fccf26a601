"""Judges that answer by rule, for queries; tasks import this module alone."""

from __future__ import annotations

import json

from caravel.functions import judgements


class RuleJudge:
    """Answers by rule, for tests and queries: wrong form for prompts that end in 3 until asked again, an error for those that end in 7."""

    def text(self, prompt: str, max_new_tokens: int) -> str:
        number = int(prompt.rsplit("#", 1)[1])
        if number % 10 == 7:
            raise RuntimeError("no memory")
        if number % 10 == 9 or (number % 10 == 3 and not prompt.startswith("Answer in")):
            return f"I would say {number % 3 / 2}"
        return json.dumps({"correctness": (number % 3) / 2, "reason": "by rule"})


LIST_FACTS, CHECK_FACTS = "List the facts.", "Check the facts."


class FactRule:
    """Lists the sentences of an answer as facts and holds those true whose number is above 20; answers about a question that ends in 9 in a wrong form."""

    def text(self, prompt: str, max_new_tokens: int) -> str:
        task, _, about = prompt.partition(LIST_FACTS if LIST_FACTS in prompt else CHECK_FACTS)
        given = json.loads(about)
        if "prediction" in given:
            return json.dumps({"facts": [s.strip() for s in given["prediction"].split(".") if s.strip()]})
        supported = lambda c: "yes" if given["question"].endswith("9") and c["id"] == 1 else int(c["claim"].split()[-1]) > 20
        return json.dumps({"verdicts": [{"id": c["id"], "supported": supported(c), "reason": "by its number"} for c in given["claims"]]})


class Echo:
    """Says what it is asked."""

    def text(self, prompt: str, max_new_tokens: int) -> str:
        return prompt


def listed(raw: str, kind: str) -> list[str]:
    return judgements.read_facts(raw) if kind == "facts" else judgements.read_claims(raw)


MEANING = "Compare the meanings."


class Judges(FactRule):
    """``FactRule``, and meanings by whether the reference's first character is even."""

    def text(self, prompt: str, max_new_tokens: int) -> str:
        if MEANING in prompt:
            return json.dumps({"correctness": 1 if int(json.loads(prompt.partition(MEANING)[2])["reference"][0]) % 2 == 0 else 0.5, "reason": "by its number"})
        return super().text(prompt, max_new_tokens)
