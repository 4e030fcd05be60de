import json
import os


from corpusflow.plans import flows
from test_io import _write_folders


def test_prepare_train_evaluate_compare_predict(spark, tmp_dir):
    root = os.path.join(tmp_dir, "Dataset")
    _write_folders(spark, root, n=60)
    out = os.path.join(tmp_dir, "out")
    prepared, dim, stats = flows.prepare_corpus(spark, root, out, labels=["Cancer", "Non-Cancer"], csv=True)
    scopes = {r.scope: r.num_samples for r in stats.collect()}
    assert scopes["global"] == 61 and scopes["train"] == 48 and scopes["val"] == 6 and scopes["test"] == 7
    assert os.path.isdir(os.path.join(out, "prepared", "split=train"))
    model = flows.train_naive_bayes(prepared, dim, os.path.join(out, "nb"))
    preds = flows.nb_predictions(model, prepared)
    names = {0: "Cancer", 1: "Non-Cancer"}
    m = flows.evaluate_model(preds, names, "nb", os.path.join(out, "eval"), splits=["val", "test"])
    assert {r.split for r in m.collect()} == {"val", "test"}
    files = [os.path.join(dp, f) for dp, _, fs in os.walk(os.path.join(out, "eval")) for f in fs if f.startswith("part-")]
    rec = json.loads(open([f for f in files if "split=test" in f][0]).readline())
    assert "f1_score" in rec and "classification_report" in rec and "Non-Cancer" in rec["classification_report"]
    base = os.path.join(tmp_dir, "base.json")
    with open(base, "w") as f:
        json.dump(rec, f)
    cmp = flows.compare_models(spark, base, os.path.join(tmp_dir, "missing.json")).first()
    assert cmp.delta_accuracy is None and "accuracy" in cmp.missing
    csv = os.path.join(tmp_dir, "score.csv")
    with open(csv, "w") as f:
        f.write("text\n\"This study focuses on lung cancer treatment.\"\nplain words\n")
    p = {r.abstract_id: r for r in flows.predict_file(spark, csv, model, os.path.join(out, "pred")).collect()}
    assert p["id_0"].extracted_diseases == ["Lung Cancer"] and set(p) == {"id_0", "id_1"}
