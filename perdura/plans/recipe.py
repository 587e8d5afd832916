"""The ordered feature recipes of the study as ``pyspark.ml`` pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.sql import DataFrame

from perdura.operators import transforms as t
from perdura.operators.sides import JoinSides, joined_features
from perdura.sources.schemas import PUBLICATION_FEATURES

# Feature names of the recipes, in output order.
URL_COLUMNS = ("protocol_type", "url_depth", "has_www", "subdomain_level", "param_cnt")
PAGE_COLUMNS = (
    "code_size",
    "title_length",
    "internal_js_cnt",
    "external_js_cnt",
    "charset",
    "is_html5",
    "has_iframe",
    "hyperlink_cnt",
)
LOGGED = ("suffix", "title_length", "internal_js_cnt", "external_js_cnt", "hyperlink_cnt")


@dataclass(frozen=True)
class Recipe:
    """What a recipe does beyond the shared URL steps."""

    label: str = "tobit"  # or "age"
    suffix: str = "dummies"  # or "frequency"
    encode: str | None = "charset"  # category encoded by frequency
    map_protocol: bool = True  # http -> 1, https -> 0
    page: bool = True
    page_shape: bool = False  # code_size and is_html5
    drop_empty_html: bool = False
    publication: bool = True
    first_appear: bool = True
    log_columns: tuple[str, ...] = ()
    low_variance: float | None = None
    drop: tuple[str, ...] = ("is_port_access",)
    scale: str | None = "tobit"  # "plain" or None
    keep_url: bool = True
    only_present_suffixes: bool = False


# The options of each edition.
RECIPES: dict[str, Recipe] = {
    "untruncated": Recipe(),
    "truncated": Recipe(keep_url=False),
    "raw": Recipe(encode=None, scale=None),
    "edition_1": Recipe(
        label="age", suffix="frequency", encode="protocol_type", map_protocol=False,
        page=False, publication=False, first_appear=False, low_variance=0.005,
        drop=("param_cnt", "is_port_access"), scale="plain", keep_url=False,
    ),
    "edition_2": Recipe(
        label="age", suffix="frequency", encode="protocol_type", map_protocol=False,
        page=False, publication=False, first_appear=False, log_columns=("suffix",),
        drop=("param_cnt", "is_port_access"), scale="plain", keep_url=False,
    ),
    "edition_3": Recipe(
        label="age", encode="protocol_type", map_protocol=False, page=False,
        publication=False, first_appear=False, drop=("param_cnt", "is_port_access"),
        scale="plain", keep_url=False,
    ),
    "edition_4": Recipe(
        label="age", suffix="frequency", map_protocol=True, page_shape=True,
        drop_empty_html=True, publication=False, first_appear=False, drop=(),
        scale="plain", keep_url=False,
    ),
    "edition_5": Recipe(
        label="age", suffix="frequency", page_shape=True, first_appear=False,
        log_columns=LOGGED, drop=("param_cnt", "is_port_access"), scale="plain",
        keep_url=False,
    ),
    "edition_6": Recipe(label="age", scale="plain", keep_url=False),
}


def picked_columns(r: Recipe) -> list[str]:
    names = [*URL_COLUMNS, "suffix" if r.suffix == "frequency" else "suffix_idx"]
    names.append("is_port_access")
    if r.page:
        names += [c for c in PAGE_COLUMNS if r.page_shape or c not in ("code_size", "is_html5")]
    if r.first_appear:
        names.append("first_appear")
    if r.publication:
        names += PUBLICATION_FEATURES
    names.append("label")
    return [*names, "url"] if r.keep_url else names


def build_recipe(r: Recipe, extra: tuple[str, ...] = ()) -> Pipeline:
    """``extra`` columns (a row key, say) ride along unscaled."""
    stages: list = [t.TobitLabel() if r.label == "tobit" else t.AgeLabel(), t.UrlFeatures()]
    stages.append(t.RenameColumns(mapping={"scheme": "protocol_type"}))
    stages.append(t.ContentType())
    stages.append(t.PresenceFlags(columns=["content_type"]))
    if r.drop_empty_html:
        stages.append(t.EmptyHtmlFilter())
    if r.page_shape:
        stages.append(t.PageShape())
    if r.page:
        stages.append(t.PageFeatures())
    if r.map_protocol:
        stages.append(t.MapValues(inputCol="protocol_type", pairs=[["http", 1], ["https", 0]]))
    if r.publication:
        stages.append(t.NanToZero(columns=list(PUBLICATION_FEATURES)))
    stages.append(t.PickColumns(columns=[*picked_columns(r), *extra]))
    stages.append(t.StagedRows())
    if r.suffix == "dummies":
        stages.append(t.SuffixDummies(presentOnly=r.only_present_suffixes))
    else:
        stages.append(t.FrequencyEncoder(inputCol="suffix"))
    if r.encode:
        stages.append(t.FrequencyEncoder(inputCol=r.encode))
    if r.low_variance is not None:
        stages.append(t.LowVarianceFilter(threshold=r.low_variance))
    if r.drop:
        stages.append(t.DropColumns(columns=list(r.drop)))
    if r.log_columns:
        stages.append(t.LogFeatures(columns=list(r.log_columns)))
    if r.scale:
        passed = [*extra, "url"] if r.keep_url else list(extra)
        raw = ["first_appear"] if r.scale == "tobit" else []
        stages.append(t.PopulationScaler(passCols=passed, keepRaw=raw))
    return Pipeline(stages=stages)


@dataclass(frozen=True)
class StudyRecipe:
    """A recipe fitted on the sides of the extract, its stateless stages run below the join.

    ``fit`` learns from the sides it is given; ``refit=True`` in ``transform`` learns again
    from the rows to transform, as the study does with its test rows.
    """

    recipe: Recipe
    extra: tuple[str, ...] = ()

    def _split(self) -> tuple[list[Transformer], list]:
        stages = build_recipe(self.recipe, self.extra).getStages()
        first = next(i for i, s in enumerate(stages) if isinstance(s, t.StagedRows))
        return stages[:first], stages[first:]

    def features(self, sides: JoinSides) -> DataFrame:
        """The unfitted features of the joined rows."""
        return joined_features(self._split()[0], sides)

    def fit(self, sides: JoinSides) -> StudyRecipeModel:
        return StudyRecipeModel(self, Pipeline(stages=self._split()[1]).fit(self.features(sides)))

    def fit_transform(self, sides: JoinSides) -> DataFrame:
        return self.fit(sides).transform(sides)


@dataclass(frozen=True)
class StudyRecipeModel:
    """``fitted`` is a saved pipeline's worth of statistics, over ``StudyRecipe.features``."""

    plan: StudyRecipe
    fitted: PipelineModel

    def transform(self, sides: JoinSides, refit: bool = False) -> DataFrame:
        if refit:
            return self.plan.fit_transform(sides)
        return self.fitted.transform(self.plan.features(sides))
