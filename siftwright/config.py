"""What an evaluation is made of: dimensions, weights, judges, rounds, prompts."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

PROMPTS = str(Path(__file__).parent / "data" / "judge_prompts.jsonl")

# fixed values: names, order, weights and labels of dimensions, labels of judges
DIMENSIONS = ("safety", "accuracy", "diversity", "format")
WEIGHTS = {"safety": 0.35, "accuracy": 0.30, "diversity": 0.20, "format": 0.15}
LABELS = {"safety": "安全性", "accuracy": "准确性", "diversity": "多样性", "format": "格式"}
MODELS = (("deepseek", "DeepSeek(deepseek-chat)"), ("glm53", "GLM-5.3（硅基流动）"), ("qwen36", "Qwen3.6-35B-A3B（硅基流动）"))
# fixed values: wording that follows the base prompt from the second round on, outcomes and the parse failure
REFINE_HEAD = "[上一轮评估结果与修正要求]"
REFINE_LINE = ("- ", "：评分 ", "，理由：")
REFINE_NONE = "未评分"
REFINE_TAIL = (
    "请参考上一轮各模型的评分与理由，重新独立评估本条语料。"
    "若你认为其他模型指出的问题更合理，请修正你的分数；若坚持原判，请给出更有力的理由。"
    '仍然严格按照格式输出分数："[[rating]]"，例如 "[[8]]"。'
)
REFINE_REASON = 400
PASSED, FAILED = "合格", "不合格"
UNPARSED = "分数解析失败"


@dataclass(frozen=True)
class EvalConfig:
    """A dimension without a weight counts 0; further dimensions and judges need no code."""

    dimensions: tuple[str, ...] = DIMENSIONS
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    labels: dict[str, str] = field(default_factory=lambda: dict(LABELS))
    models: tuple[tuple[str, str], ...] = MODELS
    rounds: int = 3
    threshold: float = 5.0
    prompts: str = PROMPTS

    def __post_init__(self) -> None:
        if self.rounds < 1:
            raise ValueError("rounds must be at least 1")
