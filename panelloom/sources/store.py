"""Saving and loading of fitted panels: state as Parquet, models in their own format, settings as one file."""

from __future__ import annotations

import importlib
from typing import Any

from pyspark import cloudpickle

from ..operators.models import ArrayModel, FeatureModel, Fitted


def _write(spark, path: str, data: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _read(spark, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def save(panel: Any, path: str) -> None:
    """Writes below path: settings, history, models and, where there are any, scores."""
    plan = panel.plan
    spark = plan.history.sparkSession
    models = {}
    for name, own in panel.fitted.items():
        for h, fitted in own.items() if isinstance(own, dict) else [(0, own)]:
            if isinstance(fitted.model, FeatureModel):
                models[name, h] = ("feature", fitted.model.feature, fitted.features)
            elif isinstance(fitted.model, ArrayModel):
                models[name, h] = ("array", fitted.model, fitted.features)
            else:
                fitted.model.write().overwrite().save(f"{path}/models/{name}/{h}")
                models[name, h] = (type(fitted.model).__module__, type(fitted.model).__name__, fitted.features)
    states = []
    for i, t in enumerate(plan.transforms):
        own = {k: v for k, v in vars(t).items() if k not in ("state", "stages")}
        states.append((type(t), own, getattr(t, "state", None) is not None))
        if states[-1][2]:
            t.state.write.mode("overwrite").parquet(f"{path}/targets/{i}")
    plan.original.write.mode("overwrite").parquet(f"{path}/history")
    if panel.scores is not None:
        panel.scores.write.mode("overwrite").parquet(f"{path}/scores")
    keep = {k: getattr(plan, k) for k in ("statics", "dynamics", "inputs", "shown", "weight", "keep", "kind")}
    options = {k: v for k, v in panel.options.items() if k != "target_transforms"}
    settings = dict(options=options, roles=panel.roles, plan=keep, steps=panel.steps, models=models, states=states,
                    intervals=getattr(panel, "intervals", None), scored=panel.scores is not None)
    _write(spark, f"{path}/settings.pkl", cloudpickle.dumps(settings))


def load(spark, path: str) -> Any:
    """A panel that predicts as the saved one did. Settings are pickled: load only what you saved yourself."""
    import pickle

    from ..plans.engine import Panel

    found = pickle.loads(_read(spark, f"{path}/settings.pkl"))
    transforms = []
    for i, (kind, own, has_state) in enumerate(found["states"]):
        t = kind.__new__(kind)
        vars(t).update(own)
        if has_state:
            t.state = spark.read.parquet(f"{path}/targets/{i}")
        transforms.append(t)
    r = found["roles"]
    panel = Panel({}, **found["options"], target_transforms=transforms or None, id_col=r.id, time_col=r.time, target_col=r.target)
    plan = panel.plan
    plan.transforms = transforms
    for k, v in found["plan"].items():
        setattr(plan, k, v)
    plan.original = plan.history = panel.source = spark.read.parquet(f"{path}/history")
    for t in transforms:
        plan.history = t.update(plan.history)
    panel.steps, panel.fitted = found["steps"], {}
    for (name, h), (module, kind, features) in found["models"].items():
        model = FeatureModel(kind) if module == "feature" else kind if module == "array" else getattr(importlib.import_module(module), kind).load(f"{path}/models/{name}/{h}")
        fitted = Fitted(model, features)
        if panel.steps:
            panel.fitted.setdefault(name, {})[h] = fitted
        else:
            panel.fitted[name] = fitted
    panel.intervals = found["intervals"]
    panel.scores = spark.read.parquet(f"{path}/scores") if found["scored"] else None
    return panel
