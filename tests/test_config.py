from twinsight.config import DEFAULT, load


def test_load(tmp_path):
    assert load(str(tmp_path)) == DEFAULT
    (tmp_path / "twinsight.toml").write_text('[thresholds]\nmin_unit_tokens = 7\nmarkers = ["x"]\nunheard_of = 1\n')
    got = load(str(tmp_path))
    assert (got.min_unit_tokens, got.markers, got.df_cap) == (7, ("x",), DEFAULT.df_cap)
