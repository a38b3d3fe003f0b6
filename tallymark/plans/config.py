"""A whole run from one configuration: eight sections as a dict or JSON file, checked in full before anything is read.

Sections: global, data, steps, binning, screening, modeling, rules, variables. All errors are collected and raised as one ValueError.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import TREND_CODES
from ..operators import splitting
from ..operators.rules import rules_table
from ..sources.files import read_csv, write_rules
from .chain import Chain, Spec
from .report import Report


@dataclass(frozen=True)
class Parameter:
    default: object
    allowed: tuple = ()
    """Choices, or (least, largest) for numbers."""


def flag(on: bool) -> Parameter:
    return Parameter("on" if on else "off", ("on", "off"))


# Parameters, defaults and what is allowed.
PARAMETERS: dict[str, dict[str, Parameter]] = {
    "global": {"project_name": Parameter("scorecard"), "modeler": Parameter(""), "purpose": Parameter(""), "random_seed": Parameter(42)},
    "data": {
        "data_file": Parameter(None), "target": Parameter(None), "time_col": Parameter(None), "id_col": Parameter(None), "dev_start": Parameter(None), "dev_end": Parameter(None),
        "train_ratio": Parameter(0.7, (0.5, 0.9)), "oot_start": Parameter(None), "oot_end": Parameter(None),
    },
    "steps": {s: flag(s not in ("mine_rules", "monitor")) for s in ("detect", "quality", "prefilter", "refine", "select", "evaluate", "report", "mine_rules", "monitor")},
    "binning": {
        "method": Parameter("chi", ("chi", "tree", "distance", "frequency")), "n_bins": Parameter(5, (3, 10)), "min_bin_pct": Parameter(0.05, (0.01, 0.20)),
        "adjust_shape": flag(True), "missing_combine": Parameter("none", ("none", "near", "worst")),
    },
    "screening": {
        "max_missing_rate": Parameter(0.8, (0.1, 0.95)), "max_one_value_rate": Parameter(0.95, (0.8, 0.99)), "iv_low": Parameter(0.02, (0, 0.15)), "iv_high": Parameter(None, (0, 100)),
        "max_psi": Parameter(None, (0.05, 0.25)), "max_corr": Parameter(0.8, (0.6, 0.95)), "max_vif": Parameter(10, (3, 10)), "min_auc": Parameter(None, (0.5, 0.7)),
    },
    "modeling": {
        "n_min": Parameter(5, (2, 20)), "n_max": Parameter(12, (3, 30)), "pvalue_threshold": Parameter(0.05, (0.01, 0.20)), "coef_sign": Parameter("positive", ("positive", "negative", "")),
        "force_fill": flag(True), "perturbation": flag(True), "max_iter_round": Parameter(100, (2, 200)), "odds": Parameter(20, (10, 100)), "pdo": Parameter(20, (10, 50)), "base_score": Parameter(600, (400, 800)),
    },
    "rules": {
        "method": Parameter("exhaustive", ("exhaustive", "tree", "apriori")), "max_depth": Parameter(3, (1, 3)), "max_tree_depth": Parameter(4, (2, 8)), "min_lift": Parameter(3, (1, 10)),
        "min_hit_rate": Parameter(0.02, (0.001, 0.5)), "max_hit_rate": Parameter(0.20, (0.01, 0.8)), "max_rules": Parameter(15, (1, 100)), "random_state": Parameter(42), "export_csv": flag(True),
    },
}
VARIABLE = ("variable", "name", "dimension", "monotonic", "special_values", "forced_in")


def _bad_value(name: str, p: Parameter, value: object) -> str | None:
    if value is None or not p.allowed:
        return None
    if isinstance(p.allowed[0], str):
        return None if value in p.allowed else f"{name}: {value!r} is none of {p.allowed}"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f"{name}: {value!r} is no number"
    return None if p.allowed[0] <= value <= p.allowed[1] else f"{name}: {value!r} is not within {p.allowed}"


@dataclass
class Config:
    values: dict[str, dict]
    variables: list[dict] = field(default_factory=list)

    @classmethod
    def parse(cls, raw: dict) -> Config:
        """From a dict of sections; a ValueError lists everything that is wrong. Empty values mean the default."""
        errors, values = [], {}
        errors += [f"unknown section {s!r}" for s in raw if s not in PARAMETERS and s != "variables"]
        for section, parameters in PARAMETERS.items():
            own = raw.get(section) or {}
            errors += [f"{section}.{k} is unknown" for k in own if k not in parameters]
            values[section] = {k: p.default if own.get(k) in (None, "") and p.default is not None and "" not in p.allowed else own.get(k, p.default) for k, p in parameters.items()}
            errors += [e for k, p in parameters.items() if (e := _bad_value(f"{section}.{k}", p, values[section][k]))]
        variables = []
        for i, row in enumerate(raw.get("variables") or []):
            errors += [f"variables[{i}].{k} is unknown" for k in row if k not in VARIABLE]
            if not row.get("variable"):
                errors.append(f"variables[{i}] has no name")
            if row.get("monotonic") and str(row["monotonic"]).lower() not in TREND_CODES:
                errors.append(f"variables[{i}]: the trend {row['monotonic']!r} is unknown")
            variables.append(row)
        names = [r.get("variable") for r in variables]
        errors += [f"variable {n!r} is listed twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
        data, model, rules = values["data"], values["modeling"], values["rules"]
        errors += [f"data.{k} is needed" for k in ("data_file", "target") if not data[k]]
        if not data["time_col"] and any(data[k] for k in ("dev_start", "dev_end", "oot_start", "oot_end")):
            errors.append("data.time_col is needed for the time ranges")
        if not errors and model["n_min"] > model["n_max"]:
            errors.append("modeling.n_min is above n_max")
        if not errors and rules["min_hit_rate"] > rules["max_hit_rate"]:
            errors.append("rules.min_hit_rate is above max_hit_rate")
        if errors:
            raise ValueError("; ".join(errors))
        return cls(values, variables)

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path) as file:
            return cls.parse(json.load(file))

    def on(self, section: str, key: str) -> bool:
        return self.values[section][key] == "on"

    def feature_config(self) -> dict[str, dict]:
        out = {}
        for row in self.variables:
            own: dict = {}
            if row.get("monotonic"):
                own["monotonic"] = str(row["monotonic"]).lower()
            if row.get("special_values"):
                own["special_values"] = tuple(float(x) for x in str(row["special_values"]).split(","))
            if own:
                out[row["variable"]] = own
        return out

    def feature_belong(self) -> dict[str, str]:
        return {r["variable"]: r["dimension"] for r in self.variables if r.get("dimension")}

    def forced(self) -> list[str]:
        return [r["variable"] for r in self.variables if r.get("forced_in") == "on"]

    def spec(self) -> Spec:
        s, b, m, r = (self.values[k] for k in ("screening", "binning", "modeling", "rules"))
        limits = {k: s[k] for k in ("max_missing_rate", "max_one_value_rate", "min_auc")}
        return Spec(
            prefilter=limits | {"iv_range": (None, None), "max_psi": None, "max_corr": None},
            binning={"method": b["method"], "n_bins": int(b["n_bins"]), "min_bin_pct": b["min_bin_pct"], "adjust_shape": self.on("binning", "adjust_shape"), "missing_combine": b["missing_combine"]},
            refine={"max_missing_rate": s["max_missing_rate"], "max_one_value_rate": s["max_one_value_rate"], "iv_range": (s["iv_low"], s["iv_high"]), "max_psi": s["max_psi"], "max_corr": s["max_corr"], "max_vif": s["max_vif"]},
            select={k: m[k] for k in ("n_min", "n_max", "pvalue_threshold", "coef_sign", "max_iter_round")}
            | {"force_fill": self.on("modeling", "force_fill"), "perturbation": self.on("modeling", "perturbation"), "random_state": self.values["global"]["random_seed"]},
            model={k: m[k] for k in ("odds", "pdo", "base_score")},
            rules={k: r[k] for k in ("method", "max_depth", "max_tree_depth", "min_lift", "min_hit_rate", "max_hit_rate", "max_rules")},
        )

    def samples(self, df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Train, test and out-of-time samples; the time column and the id leave the features."""
        d = self.values["data"]
        missing = [c for c in (d["target"], d["time_col"], d["id_col"]) if c and c not in df.columns] + [r["variable"] for r in self.variables if r["variable"] not in df.columns]
        if missing:
            raise ValueError(f"the data have no columns {missing}")
        dev, oot = df, None
        if d["time_col"]:
            dev, found = splitting.split_time(df, d["time_col"], (d["dev_start"], d["dev_end"]), (d["oot_start"], d["oot_end"]))
            oot = found if d["oot_start"] else None
        key = [d["id_col"]] if d["id_col"] else [c for c in df.columns if c != d["target"]]
        split = splitting.split_by_class(dev, d["target"], key, d["train_ratio"], int(self.values["global"]["random_seed"]))
        gone = [c for c in (d["time_col"], d["id_col"]) if c]
        parts = (split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split"), oot)
        return tuple(p.drop(*gone) if p is not None else None for p in parts)  # type: ignore[return-value]

    def execute(self, spark: SparkSession, out: str | None = None) -> Chain:
        """Runs the steps that are on; with out, reports and rules are written there."""
        train, test, oot = self.samples(read_csv(spark, self.values["data"]["data_file"]))
        chain = Chain(self.spec()).read(train.persist(), target=self.values["data"]["target"], test=test.persist(), oot=oot)
        for step in ("detect", "quality", "prefilter"):
            if self.on("steps", step):
                getattr(chain, step)()
        chain.bin(self.feature_config())
        if self.on("steps", "refine"):
            chain.refine()
        if self.on("steps", "mine_rules"):
            chain.mine_rules()
        chain.transform()
        if self.on("steps", "select"):
            chain.select([c for c in self.forced() if c in chain.features], **({"feature_belong": {c: v for c, v in self.feature_belong().items() if c in chain.features}} if self.feature_belong() else {}))
        chain.fit().scorecard()
        if self.on("steps", "evaluate"):
            chain.evaluate().diagnose()
        if out and self.on("steps", "report"):
            Report.of(chain, self.values["global"]["project_name"]).save(f"{out}/report.md")
        if out and chain.rules_ and self.on("rules", "export_csv"):
            n, bad = train.agg(F.count("*"), F.sum(self.values["data"]["target"])).first()
            write_rules(rules_table(spark, chain.rules_, n, bad), f"{out}/rules_table")
        return chain

    def script(self) -> str:
        """A Python script that does the same."""
        raw = {k: {p: v for p, v in own.items() if v != PARAMETERS[k][p].default} for k, own in self.values.items()} | {"variables": self.variables}
        body = json.dumps({k: v for k, v in raw.items() if v}, indent=4, ensure_ascii=False)
        return f"from tallymark.plans.config import Config\nfrom tallymark.session import local_session\n\nconfig = Config.parse({body})\nchain = config.execute(local_session(), out='.')\n"


def template() -> dict:
    """A configuration with all defaults, to fill in."""
    return {s: {k: p.default for k, p in ps.items()} for s, ps in PARAMETERS.items()} | {"variables": [{k: "" for k in VARIABLE}][:0]}
