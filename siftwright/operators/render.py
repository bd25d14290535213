"""Results as plain text, for a console.  Tables are a row a dimension, model or run, so they are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import EvalConfig
from . import evaluate
from .stats import bars

# headings and column names
TITLE, AVERAGES, SPREAD, AGREEMENT = "语料质量评估 · 统计分析报告", "各维度平均分（每个 █ 代表 1 分）：", "各维度分数分布（<4 / 4–7 / ≥7）：", "各模型打分一致性："
COLUMNS = ("模型", "样本", "平均分", "标准差", "与它模型均差")
UNSCORED = "未评分"
NOTHING, NO_ROUNDS = "（无有效数据）", "（rounds 数据不完整，无法计算模型一致性）"


def _two(x: float | None) -> str:
    return "N/A" if x is None else f"{x:.2f}"


def statistics_text(summary: DataFrame, dims: DataFrame, models: DataFrame, threshold: float) -> str:
    """stats.summary, stats.dim_table and stats.model_table as one text."""
    s = summary.first()
    out = [TITLE, f"  总语料数量: {s.total}"]
    if s.total:
        out += [f"  合格（>= {threshold:g}）: {s.passed}（{s.passed_percent:.1f}%）", f"  不合格: {s.failed}（{s.failed_percent:.1f}%）"]
        out += [f"  分数缺失/异常: {s.invalid}"] * (s.invalid > 0)
    else:
        out.append(f"  {NOTHING}")
    table = bars(dims).orderBy("place").collect()
    out += ["", AVERAGES, *(f"  {d.label}  {d.bar}  {_two(d.average)}" for d in table), "", SPREAD]
    for d in table:
        shares = [f"{100 * c / d.n:5.1f}%" if d.n else "  -  " for c in (d.low, d.middle, d.high)]
        out.append(f"  {d.label}: " + " / ".join(shares))
    out += ["", AGREEMENT]
    found = models.orderBy("model").collect()
    out += ["  " + "  ".join(COLUMNS)] if found else [f"  {NO_ROUNDS}"]
    out += [f"  {m.model}  {m.n}  {_two(m.mean)}  {_two(m.std)}  {_two(m.mean_diff)}" for m in found]
    return "\n".join(out)


def evaluation_text(judged: DataFrame, cfg: EvalConfig) -> str:
    """One document's judgments of all rounds: what each dimension adds to its score, the verdict, and scores by round."""
    scores = evaluate.dim_scores(judged.where(F.col("round") == cfg.rounds))
    parts = {r.dim: r for r in evaluate.contributions(scores, cfg).collect()}
    final = evaluate.final_scores(scores, cfg).first()
    trends = {r.dim: r for r in evaluate.round_trend(judged, cfg).withColumn("arrow", evaluate.arrow(F.col("trend"))).collect()}
    name = lambda d: cfg.labels.get(d, d)
    out = ["评估结果"]
    for d in cfg.dimensions:
        r = parts.get(d)
        out.append(f"  {name(d)}: {UNSCORED}" if r is None or r.score is None else f"  {name(d)}: {r.score:g} × {r.percent}% = {r.part:.2f}")
    overall = final.overall_score if final else None
    out += [f"  综合: {UNSCORED if overall is None else f'{overall:g}'}（阈值 {cfg.threshold:g}）", f"  结论: {final.conclusion if final else C.FAILED}", "", "各轮变化"]
    for d in cfg.dimensions:
        trend = trends[d].trend if d in trends else [None] * cfg.rounds
        out.append(f"  {name(d)}  " + "  ".join("--" if s is None else f"{s:g}" for s in trend) + f"  {trends[d].arrow if d in trends else '→'}")
    return "\n".join(out)


def conversion_text(counts: DataFrame, kind: str, path: str, threshold: float) -> str:
    """stats.convert_stats as text."""
    s = counts.first()
    out = ["转换统计", f"  读取: {s.total}", f"  保留（>= {threshold:g}）: {s.kept}", f"  得分不足: {s.low}", f"  无法使用: {s.skipped}"]
    out += [f"  其中无结构文本: {s.plain}"] * (s.plain > 0)
    return "\n".join([*out, f"  格式: {kind}", f"  输出: {path}"])


def run_text(summary: DataFrame, threshold: float, path: str) -> str:
    """stats.run_summary as text."""
    s = summary.first()
    out = ["汇总", f"  共处理: {s.total}", f"  合格（>= {threshold:g}）: {s.passed}", f"  不合格: {s.failed}"]
    return "\n".join([*out, *[f"  评分无效: {s.invalid}"] * (s.invalid > 0), f"  输出: {path}"])
