"""Scoring a reconstruction: metric names in, long metric rows out."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.keys import BAR, PITCHES, STEPS, TRACK
from staffline.operators import image_metrics, note_metrics, render, vectors
from staffline.operators.ingest import track_name
from staffline.operators.numbering import durable
from staffline.plans.experiment import to_long

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Tables:
    """Inputs of an evaluation; an absent frame switches its metrics off.

    ``true`` holds segments; it and ``plane`` are partitioned by bar, ``pred`` comes from
    ``compact_notes``. Persist them when several families are scored. ``bars`` lists the
    reconstructed bars, silent ones included: a true bar that is not among them is not scored,
    one that is there without notes or pixels is scored as silent. Without ``bars`` every true bar counts
    as reconstructed. ``latents`` has the bar, ``z`` and perhaps ``condition_label``; ``latent_shape`` is its
    (channels, height, width). Where ``recon_pixels`` is of another size, ``recon_size`` (height, width) says so, and it
    is brought to the true image's size before pixels are compared.
    """

    true: DataFrame
    pred: DataFrame | None = None
    plane: DataFrame | None = None
    true_pixels: DataFrame | None = None
    recon_pixels: DataFrame | None = None
    bars: DataFrame | None = None
    latents: DataFrame | None = None
    latent_shape: tuple[int, int, int] = (4, 16, 16)
    height: int = PITCHES
    steps: int = STEPS
    recon_size: tuple[int, int] | None = None


def matched(tables: Tables) -> Tables:
    """Every frame cut to the reconstructed bars; frames that lie by bar are not moved for it."""
    if tables.bars is None:
        return tables
    bars = tables.bars.select(*BAR).distinct()
    names = ("true", "pred", "plane", "true_pixels", "recon_pixels", "latents")
    frames = {n: getattr(tables, n) for n in names}
    return replace(tables, **{n: f.join(bars, list(BAR), "left_semi") for n, f in frames.items() if f is not None})


Family = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Metric:
    family: Family
    columns: tuple[str, ...]
    needs: frozenset[str]


def _steps(t: Tables) -> DataFrame:
    return note_metrics.step_profiles(t.true, t.pred, t.steps)


def _classes(t: Tables) -> DataFrame:
    return note_metrics.pitch_class_scores(t.true, t.pred)


def _alignment(t: Tables) -> DataFrame:
    return note_metrics.pitch_alignment(t.true, t.pred, t.plane, t.height)


def _intervals(t: Tables) -> DataFrame:
    return note_metrics.interval_scores(t.true, t.pred)


def _velocities(t: Tables) -> DataFrame:
    return note_metrics.velocity_histogram_kl(t.true, t.pred)


def _onset(t: Tables) -> DataFrame:
    return note_metrics.bar_scores(t.true, t.pred, ["onsets"], t.steps).where("onset_f1 IS NOT NULL")


def _ioi(t: Tables) -> DataFrame:
    return note_metrics.bar_scores(t.true, t.pred, ["ioi"], t.steps).where("ioi_distribution_kl IS NOT NULL")


def _groove(t: Tables) -> DataFrame:
    return note_metrics.bar_scores(t.true, t.pred, ["groove"], t.steps).where("groove_consistency IS NOT NULL")


#: Families of per-bar note metrics that ``note_metrics.bar_scores`` gives together.
_OF_NOTES: dict[Family, str] = {_steps: "steps", _classes: "classes", _onset: "onsets", _ioi: "ioi", _groove: "groove"}


def _same_size(t: Tables) -> DataFrame:
    """The reconstructed pixels at the size of the true ones."""
    size = (t.height, t.steps)
    return t.recon_pixels if t.recon_size in (None, size) else render.resize(t.recon_pixels, t.recon_size, size, "bilinear")


def _pixels(t: Tables) -> DataFrame:
    return image_metrics.pixel_scores(t.true_pixels, t.recon_pixels, t.height, t.steps, t.recon_size)


def _ssim(t: Tables) -> DataFrame:
    return image_metrics.ssim(t.true_pixels, _same_size(t), t.height, t.steps)


def _rows(t: Tables) -> DataFrame:
    return image_metrics.row_scores(t.true, t.plane, t.height, t.steps, t.steps)


def _mi(t: Tables) -> DataFrame:
    return image_metrics.mutual_information(t.true, t.plane, height=t.height, width=t.steps, steps=t.steps)


def _nll(t: Tables) -> DataFrame:
    return image_metrics.bar_nll(t.true, t.plane, t.height, t.steps)


def _latent_variance(t: Tables) -> DataFrame:
    channels, height, width = t.latent_shape
    return vectors.channel_variance(t.latents, BAR, channels, height * width)


def _latent_correlation(t: Tables) -> DataFrame:
    channels, height, width = t.latent_shape
    return vectors.channel_correlation(t.latents, BAR, channels, height * width)


# -- metrics of sequences and of whole tables --------------------------------------------------------

@dataclass(frozen=True)
class Sums:
    """A metric of sequences (``TRACK``) or of the whole table (no scope) as a state that merges.

    ``rows`` gives the values that each bar brings, ``state`` how they add up (any mergeable aggregates) and ``final`` the results as expressions
    of the merged state. Metrics of the same rows and scope are summed in one pass. Both are functions, since
    columns can't be made before there is a session.
    """

    rows: Family
    state: Callable[[], dict[str, Column]]
    final: Callable[[], dict[str, Column]]
    needs: frozenset[str]
    scope: tuple[str, ...] = TRACK


@dataclass(frozen=True)
class Whole:
    """A metric of sequences or of the whole table as a job of its own: ``compute`` gives (scope, columns)."""

    compute: Family
    columns: tuple[str, ...]
    needs: frozenset[str]
    scope: tuple[str, ...] = ()


def features(t: Tables) -> DataFrame:
    """(bar, z, instrument, label): the latent of a bar, or the channel means of its image where there are no latents."""
    if t.latents is not None:
        z = t.latents.withColumn("z", vectors.doubles("z"))
    else:
        channel = F.explode(F.when(F.col("copies") == 1, F.array("channel")).otherwise(F.sequence(F.lit(0), F.col("copies") - 1)))
        mean = lambda c: render.to_range(F.sum(F.when(F.col("c") == c, F.col("level")).otherwise(0.0)) / (t.height * t.steps))
        means = t.recon_pixels.select(*BAR, channel.alias("c"), "level").groupBy(*BAR).agg(F.array(*[mean(c) for c in range(render.CHANNELS)]).alias("z"))
        bars = (t.true if t.bars is None else t.bars).select(*BAR).distinct()  # a bar without pixels is all background
        blank = F.array(*[render.to_range(F.lit(0.0))] * render.CHANNELS)
        z = bars.join(means, list(BAR), "left").withColumn("z", F.coalesce("z", blank))
    instrument = track_name(F.col("track_idx"), F.lit(None).cast("string"))
    label = F.coalesce(F.col("condition_label").cast("string"), instrument) if "condition_label" in z.columns else instrument
    return z.select(*BAR, "z", instrument.alias("instrument"), label.alias("label"))


def _value(t: Tables, name: str, value: float) -> DataFrame:
    return t.true.sparkSession.range(1).select(F.lit(float(value)).alias(name))


def _pitch_probe(t: Tables) -> DataFrame:
    rows = durable(features(t).drop("label").join(vectors.dominant_pitch_label(t.true, BAR), list(BAR)))  # a probe reads them several times
    return _value(t, "linear_probe_pitch_accuracy", vectors.probe_accuracy(rows, BAR, "label"))


def _probe(name: str, label: str) -> Family:
    return lambda t: _value(t, name, vectors.probe_accuracy(features(t), BAR, label))


def _silhouette(t: Tables) -> DataFrame:
    return vectors.silhouette(features(t), BAR, "instrument")


def _disentanglement(t: Tables) -> DataFrame:
    return vectors.disentanglement(features(t), BAR, "instrument")


def _self_similarity(t: Tables) -> DataFrame:
    return vectors.self_similarity(features(t), TRACK)


def _smoothness(t: Tables) -> DataFrame:
    return vectors.smoothness(features(t), TRACK, "bar_index")


def _transitions(t: Tables) -> DataFrame:
    return note_metrics.transition_entropy(note_metrics.dominant_pitch_class(t.true, t.pred))


def _sequence_groove(t: Tables) -> DataFrame:
    return note_metrics.sequence_groove(note_metrics.onset_arrays(t.true, t.pred, t.steps, how="left"), steps=t.steps)


def _class_shares(t: Tables) -> DataFrame:
    return note_metrics.pitch_class_shares(t.true, t.pred, t.plane, t.height)


def _class_sums() -> dict[str, Column]:
    return {f"{side}{c}": F.sum(f"{side}{c}") for side in "tp" for c in range(12)}


def _class_kl() -> dict[str, Column]:
    return {"pitch_class_histogram_kl": note_metrics.class_sums_kl(lambda side, c: F.col(f"{side}{c}"))}


NOTES, IMAGE, PLANE = frozenset({"pred"}), frozenset({"true_pixels", "recon_pixels"}), frozenset({"plane"})
LATENTS, FEATURES = frozenset({"latents"}), frozenset({"latents|recon_pixels"})

METRICS: dict[str, Metric | Sums | Whole] = {
    "pixel_mse": Metric(_pixels, ("pixel_mse",), IMAGE),
    "psnr": Metric(_pixels, ("psnr",), IMAGE),
    "ssim": Metric(_ssim, ("ssim",), IMAGE),
    "onset_f1": Metric(_onset, ("onset_precision", "onset_recall", "onset_f1"), NOTES),
    "onset_precision": Metric(_onset, ("onset_precision",), NOTES),
    "onset_recall": Metric(_onset, ("onset_recall",), NOTES),
    "note_density_pearson": Metric(_steps, ("note_density_pearson",), NOTES),
    "pitch_class_histogram_correlation": Metric(_classes, ("pitch_class_histogram_correlation",), NOTES),
    "interval_histogram_correlation": Metric(_intervals, ("interval_histogram_correlation",), NOTES),
    "ioi_distribution_kl": Metric(_ioi, ("ioi_distribution_kl",), NOTES),
    "groove_consistency": Metric(_groove, ("groove_consistency",), NOTES),
    "velocity_mse": Metric(_steps, ("velocity_mse",), NOTES),
    "velocity_correlation": Metric(_steps, ("velocity_correlation",), NOTES),
    "velocity_histogram_kl": Metric(_velocities, ("velocity_histogram_kl",), NOTES),
    "note_entropy_diff": Metric(_rows, ("note_entropy_diff", "note_entropy_orig", "note_entropy_recon"), PLANE),
    "kl_divergence_pitch_dist": Metric(_rows, ("kl_pitch_dist",), PLANE),
    "activation_sparsity": Metric(
        _rows, ("activation_sparsity_recon", "activation_sparsity_gt", "activation_sparsity_diff"), PLANE
    ),
    "mutual_information_pitch_time": Metric(
        _mi, ("mi_pitch_time_orig", "mi_pitch_time_recon", "mi_pitch_time_diff"), PLANE
    ),
    "generative/bar_level_nll": Metric(_nll, ("bar_level_nll",), PLANE),
    "generative/sequence_coherence": Metric(
        _classes, ("seq_coherence_gt_entropy", "seq_coherence_gen_entropy", "seq_coherence_entropy_diff"), NOTES
    ),
    "conditioning/pitch_alignment": Metric(_alignment, ("conditioning_pitch_alignment",), NOTES),
    "latent_variance": Metric(_latent_variance, ("latent_variance_mean", "latent_variance_min", "latent_variance_max"), LATENTS),
    "latent_channel_correlation": Metric(
        _latent_correlation, ("latent_channel_correlation_mean", "latent_channel_correlation_max"), LATENTS
    ),
    "linear_probe_pitch_accuracy": Whole(_pitch_probe, ("linear_probe_pitch_accuracy",), LATENTS),
    "linear_probe_instrument_accuracy": Whole(
        _probe("linear_probe_instrument_accuracy", "instrument"), ("linear_probe_instrument_accuracy",), LATENTS
    ),
    "silhouette_score": Whole(_silhouette, ("silhouette_score",), LATENTS),
    "generative/self_similarity_matrix": Whole(
        _self_similarity, ("self_similarity_mean", "self_similarity_std", "self_similarity_n_bars"), FEATURES, TRACK
    ),
    "generative/transition_entropy": Whole(
        _transitions, ("transition_entropy", "transition_entropy_n_transitions"), NOTES, TRACK
    ),
    "generative/groove_consistency": Whole(
        _sequence_groove, ("seq_groove_consistency", "seq_groove_consistency_n_bars"), NOTES, TRACK
    ),
    "generative/pitch_class_histogram_kl": Sums(_class_shares, _class_sums, _class_kl, NOTES, TRACK),
    "conditioning/fidelity": Whole(_probe("conditioning_fidelity", "instrument"), ("conditioning_fidelity",), FEATURES),
    "conditioning/attribute_accuracy": Whole(
        _probe("conditioning_attribute_accuracy", "label"), ("conditioning_attribute_accuracy",), FEATURES
    ),
    "conditioning/interpolation_smoothness": Whole(
        _smoothness, ("interpolation_smoothness", "interpolation_step_size", "interpolation_n_steps"), FEATURES, TRACK
    ),
    "conditioning/disentanglement_score": Whole(
        _disentanglement, ("disentanglement_score", "intra_class_distance", "inter_class_distance"), FEATURES
    ),
}

# Names of the default groups. Costly or redundant metrics are asked for by name.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "reconstruction": ("pixel_mse", "psnr"),
    "harmony": (
        "onset_f1", "note_density_pearson", "pitch_class_histogram_correlation", "interval_histogram_correlation",
    ),
    "rhythm": ("ioi_distribution_kl", "groove_consistency"),
    "dynamics": ("velocity_mse", "velocity_correlation"),
    "information": ("note_entropy_diff", "kl_divergence_pitch_dist", "activation_sparsity"),
    "latent_space": (
        "latent_variance", "latent_channel_correlation", "linear_probe_pitch_accuracy",
        "linear_probe_instrument_accuracy", "silhouette_score",
    ),
    "generative": (
        "generative/self_similarity_matrix", "generative/transition_entropy", "generative/groove_consistency",
        "generative/pitch_class_histogram_kl", "generative/bar_level_nll", "generative/sequence_coherence",
    ),
    "conditioning": (
        "conditioning/fidelity", "conditioning/attribute_accuracy", "conditioning/interpolation_smoothness",
        "conditioning/pitch_alignment", "conditioning/disentanglement_score",
    ),
}


def register_metric(name: str, family: Family, columns: Sequence[str], needs: Iterable[str] = ()) -> None:
    """Add a per-bar metric: ``family`` maps the tables to (bar, columns...)."""
    METRICS[name] = Metric(family, tuple(columns), frozenset(needs))


def register_sums(
    name: str, rows: Family, state: Callable[[], dict[str, Column]], final: Callable[[], dict[str, Column]],
    needs: Iterable[str] = (), scope: Sequence[str] = TRACK,
) -> None:
    """Add a metric of sequences or of the whole table that is finalised from a mergeable state: see ``Sums``."""
    METRICS[name] = Sums(rows, state, final, frozenset(needs), tuple(scope))


def register_whole(name: str, compute: Family, columns: Sequence[str], needs: Iterable[str] = (), scope: Sequence[str] = ()) -> None:
    """Add a metric of sequences or of the whole table that is a job of its own: see ``Whole``."""
    METRICS[name] = Whole(compute, tuple(columns), frozenset(needs), tuple(scope))


def select_metrics(names: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Expand ``all`` and category names, drop ``-name`` entries and ``exclude``, keep first occurrences."""
    added: list[str] = []
    removed = set(exclude)
    for entry in (n.strip() for n in names):
        if entry.startswith("-"):
            removed.add(entry[1:].strip())
        elif entry == "all":
            added += sorted(METRICS)
        else:
            added += CATEGORIES.get(entry, (entry,))
    return [n for n in dict.fromkeys(added) if n not in removed]


def _long(scores: DataFrame, scope: Sequence[str], columns: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """(bar, metric, value); the part of the bar key that lies outside the scope of a metric is null."""
    bars = [F.col(k).alias(k) if k in scope else F.lit(None).cast(kinds[k]).alias(k) for k in BAR]
    return to_long(scores.select(*bars, *columns), BAR, columns)


def evaluate(tables: Tables, names: Sequence[str] = ("all",), exclude: Sequence[str] = ()) -> DataFrame:
    """(bar, metric, value) for the chosen metrics; the bar is null beyond the track in metrics of sequences, and null in those of the table.

    Each family of per-bar metrics is one job over frames already partitioned by bar, metrics with mergeable states add up in one pass
    per kind of rows, and each result is finalised here. Metrics without their inputs and unknown names are skipped with a note in
    the log. True and reconstructed bars are paired: see ``Tables.bars``.
    """
    tables = matched(tables)
    kinds = dict(tables.true.dtypes)
    there = lambda need: any(getattr(tables, n) is not None for n in need.split("|"))
    families: dict[Family, list[str]] = {}
    sums: dict[tuple[Family, tuple[str, ...]], list[Sums]] = {}
    parts = []
    for name in select_metrics(names, exclude):
        metric = METRICS.get(name)
        if metric is None:
            log.warning("metric %r is unknown - skipped", name)
        elif not all(map(there, metric.needs)):
            log.info("metric %r skipped: missing %s", name, sorted(metric.needs))
        elif isinstance(metric, Metric):
            columns = families.setdefault(metric.family, [])
            columns += [c for c in metric.columns if c not in columns]
        elif isinstance(metric, Sums):
            sums.setdefault((metric.rows, metric.scope), []).append(metric)
        else:
            parts.append(_long(metric.compute(tables), metric.scope, metric.columns, kinds))
    together = [f for f in families if f in _OF_NOTES]
    if len(together) > 1:  # one pass for all of them; a bar's score is null where its family has none
        scores = note_metrics.bar_scores(tables.true, tables.pred, [_OF_NOTES[f] for f in together], tables.steps)
        parts.append(_long(scores, BAR, [c for f in together for c in families.pop(f)], kinds))
    for family, columns in families.items():
        parts.append(_long(family(tables), BAR, columns, kinds))
    for (rows, scope), metrics in sums.items():
        states, finals = {}, {}
        for m in metrics:
            states |= m.state()
            finals |= m.final()
        merged = rows(tables).groupBy(*scope).agg(*[c.alias(n) for n, c in states.items()])
        parts.append(_long(merged.select(*scope, *[c.alias(n) for n, c in finals.items()]), scope, list(finals), kinds))
    if not parts:
        raise ValueError("no metric to compute")
    return reduce(DataFrame.unionByName, parts)


def match_report(true: DataFrame, recon_bars: DataFrame) -> DataFrame:
    """One row: reconstructed bars, those with a true bar, and those without."""
    truth = true.select(*BAR).distinct().withColumn("_true", F.lit(True))
    marked = recon_bars.select(*BAR).distinct().join(truth, list(BAR), "left")
    return marked.agg(
        F.count(F.lit(1)).alias("reconstructed"),
        F.count("_true").alias("matched"),
        F.count_if(F.col("_true").isNull()).alias("unmatched"),
    )
