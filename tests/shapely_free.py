"""Small plain helpers for the tests."""


def ring_area(points):
    """Signed area of a closed ring of x/y rows."""
    xy = [(p["x"], p["y"]) for p in points]
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, xy[1:])) / 2
