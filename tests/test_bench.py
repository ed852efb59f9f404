import pathlib

SOURCE = (pathlib.Path(__file__).parents[1] / "bench.py").read_text()


def test_headline_total_times_the_clustering():
    total = SOURCE[:SOURCE.index("total_times, times = times, {}")]
    assert '"category_segments": lambda: M.category_segments(scored)' in total and "segment_label_map" not in total
