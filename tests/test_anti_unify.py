from twinsight.functions.anti_unify import HOLE, Tree, anti_unify, render, text_tree


def test_equal_trees_have_no_hole():
    t = text_tree("a b\nc")
    r = anti_unify(t, t)
    assert (r.template, r.divergence, r.holes) == (t, 0.0, 0)


def test_one_changed_word_is_one_hole():
    r = anti_unify(text_tree("a b c d e"), text_tree("a b x d e"))
    assert r.holes == 1 and r.divergence == 2 / (2 * 7)
    assert render(r.template).split() == ["text", "line", "a", "b", "⟨h1⟩", "d", "e"]


def test_the_same_change_is_charged_once():
    one = anti_unify(text_tree("a b c d\ne b f g"), text_tree("a x c d\ne x f g"))
    two = anti_unify(text_tree("a b c d\ne h f g"), text_tree("a x c d\ne y f g"))
    assert (one.holes, two.holes) == (1, 2) and one.divergence < two.divergence


def test_gaps_and_other_kinds():
    r = anti_unify(text_tree("a b c d"), text_tree("a b z z c d"))
    assert r.holes == 1 and [c.kind for c in r.template.children[0].children].count(HOLE) == 1
    assert anti_unify(Tree("x"), Tree("y")).template.kind == HOLE


def test_very_long_lists_are_one_hole():
    a = Tree("t", None, tuple(Tree("w", str(k)) for k in range(300)))
    b = Tree("t", None, tuple(Tree("w", str(k + 1)) for k in range(300)))
    assert anti_unify(a, b).holes == 1


def test_empty_texts():
    assert anti_unify(text_tree(None), text_tree("")).holes == 0
