"""Prompt texts and chat rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentcorpus.functions.text import strip

# ---- fixed values: system prompts and prompt templates --------------------------------------
SYSTEM_PROMPTS = {
    "qa": (
        "You answer questions using only the visible browser screenshot. "
        "Give a concise answer and do not describe your reasoning."
    ),
    "grounding": (
        "You precisely locate requested interface elements in screenshots. "
        "Coordinates use a 1000 by 1000 normalized grid while the screenshot keeps its aspect ratio."
    ),
    "action": (
        "You operate a web browser from its screenshot and state. Select exactly one next action. "
        "Coordinates and scroll deltas use a 0 to 100 normalized grid. Return one JSON object with "
        'a concise "thought" and an "action" object. The action object must have a "name" and only '
        "the arguments needed by that action. Do not use Markdown."
    ),
}
QA_SUFFIX = "\nAnswer using only the screenshot."
GROUNDING_PREFIX = "Locate the interface element described as: "
GROUNDING_SUFFIX = (
    "\nReturn only a JSON list in this format: "
    '[{"point_2d":[x,y],"label":"element description"}]. '
    "Use integer coordinates from 0 to 1000."
)
GOAL_HEADING = "# GOAL"
HISTORY_HEADING = "# PREVIOUS STEPS"
STEP_HEADING = "## Step "
THOUGHT_LABEL = "THOUGHT: "
ACTION_LABEL = "ACTION: "
PAGE_HEADING = "# CURRENTLY ACTIVE PAGE"
NEXT_HEADING = "# NEXT STEP"
# ---------------------------------------------------------------------------------------------


def qa_prompt(question: Column) -> Column:
    return F.concat(strip(question), F.lit(QA_SUFFIX))


def grounding_prompt(description: Column) -> Column:
    return F.concat(F.lit(GROUNDING_PREFIX), strip(description), F.lit(GROUNDING_SUFFIX))


def action_prompt(
    goal: Column, history: Column, page_index: Column, title: Column, url: Column
) -> Column:
    """``history`` is an array of struct(step, thought, action), oldest first."""
    blocks = F.transform(
        history,
        lambda item: F.concat_ws(
            "\n",
            F.concat(F.lit(STEP_HEADING), item["step"].cast("string")),
            F.concat(F.lit(THOUGHT_LABEL), strip(F.coalesce(item["thought"], F.lit("")))),
            F.concat(F.lit(ACTION_LABEL), item["action"]),
        ),
    )
    page = F.concat(
        F.lit("Page "), page_index.cast("string"), F.lit(": "), title, F.lit(" | "), url
    )
    return strip(
        F.concat_ws(
            "\n",
            F.concat(F.lit(f"{GOAL_HEADING}\n"), strip(goal), F.lit(f"\n\n{HISTORY_HEADING}")),
            blocks,
            F.concat(F.lit(f"{PAGE_HEADING}\n"), page, F.lit(f"\n\n{NEXT_HEADING}")),
        )
    )


def system_prompt(task: Column) -> Column:
    chain = None
    for name, prompt in SYSTEM_PROMPTS.items():
        chain = F.when(task == name, F.lit(prompt)) if chain is None else chain.when(
            task == name, F.lit(prompt)
        )
    return chain.otherwise(
        F.raise_error(F.concat(F.lit("unsupported task: "), F.coalesce(task, F.lit("null"))))
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def training_prompt(task: Column, prompt: Column) -> Column:
    return F.array(_message("system", system_prompt(task)), _message("user", prompt))


def training_completion(answer: Column) -> Column:
    return F.array(_message("assistant", answer))


def inference_messages(task: Column, prompt: Column, image: Column) -> Column:
    nothing = F.lit(None).cast("string")

    def part(kind, text, picture):
        return F.struct(
            F.lit(kind).alias("type"), text.alias("text"), picture.alias("image")
        )

    return F.array(
        _message("system", F.array(part("text", system_prompt(task), nothing))),
        _message(
            "user", F.array(part("image", nothing, image), part("text", prompt, nothing))
        ),
    )
