"""Numbers of a catalog's images: places in the order of names, and no task that gets all of them."""

import random
import re

import pytest

from lattix.sources import catalog
from lattix.sources.catalog import ImageCollection, numbered

RULES = {"images": {"pattern": r".*/(S_\d+_\d+)_B.*"}, "datetime": {"pattern": r".*/S_(\d{8})_.*", "format": "%Y%m%d"}, "bands": {"B01": {"pattern": r".*_B01\.tif$"}, "B02": {"pattern": r".*_B02\.tif$"}}}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def collection(spark, n: int) -> ImageCollection:
    files = [(f"/data/S_2024{1 + k % 12:02}{1 + k % 28:02}_{k}_B{b:02}.tif",) for k in range(n) for b in ((1, 2) if k % 2 else (1,))]
    return ImageCollection.create(spark.createDataFrame(files, "descriptor string"), RULES)


@pytest.mark.parametrize("steps", [2, 10])
@pytest.mark.parametrize("n", [0, 1, 3, 3_000])
def test_numbers_are_places_in_the_order_of_names(spark, monkeypatch, n, steps):
    monkeypatch.setattr(catalog, "STEPS", steps)
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abÄ_ 0\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(n)}, key=lambda s: s.encode())
    rows = [(s,) for s in names for _ in range(1 + len(s) % 3)]
    rng.shuffle(rows)
    got = {r["name"]: r["id"] for r in numbered(spark.createDataFrame(rows, "name string")).collect()}
    assert got == {s: k + 1 for k, s in enumerate(names)}


def test_images_and_references_have_the_same_numbers(spark):
    c = collection(spark, 500)
    images = {r["id"]: r["name"] for r in c.images.collect()}
    assert list(images) and sorted(images) == list(range(1, 501)) and [images[k] for k in sorted(images)] == sorted(images.values())
    refs = c.refs.collect()
    assert len(refs) == 750 and all(f"/{images[r['image_id']]}_B" in r["descriptor"] for r in refs)


def test_no_task_numbers_all_names(spark):
    c = collection(spark, 50)
    for df in (c.images, c.refs, c.filter_bands(["B02"]).filter_datetime_range("2024-02-01", "2024-06-30").refs):
        text = plan(df)
        assert "row_number() windowspecdefinition(_range" in text
        assert not re.search(r"windowspecdefinition\(name", text)


def test_names_are_not_numbered_where_ids_are_not_asked_for(spark):
    c = collection(spark, 50)
    assert "Window" not in plan(c.images.select("name", "datetime")) and "Window" not in plan(c.extent())


def test_filter_of_bands_does_not_shuffle_by_band(spark):
    assert "hashpartitioning(band_id" not in plan(collection(spark, 50).filter_bands(["B02"]).refs)


@pytest.mark.parametrize("bands", [None, ["B01"]])
def test_find_range_does_not_shuffle_by_band(spark, bands):
    files = [(f"/data/S_2024010{k}_{k}_B0{b}.tif", 0.0, 1.0, 1.0, 0.0) for k in (3, 1, 2) for b in (1, 2)]
    found = ImageCollection.create(spark.createDataFrame(files, "descriptor string, left double, right double, top double, bottom double"), RULES).find_range(0, 1, 0, 1, "2024-01-02", "2024-01-03", bands=bands, order_by=["images.name"])
    text = plan(found)
    assert "hashpartitioning(band_id" not in text and not re.search(r"windowspecdefinition\(name", text)
    assert [(r["image_id"], r["band_name"]) for r in found.collect() if r["band_name"] == "B01"] == [(2, "B01"), (3, "B01")]
    assert found.count() == (2 if bands else 4)
