"""The rating rules one pair at a time, for small inputs."""

from __future__ import annotations

from collections import defaultdict
from math import sqrt
from statistics import fmean


class Ratings:
    """rows: (user, item, stars, order); the row of highest order counts."""

    def __init__(self, rows):
        self.by_item, self.by_user, last = defaultdict(dict), defaultdict(dict), {}
        user_stars, item_stars = defaultdict(list), defaultdict(list)
        for user, item, stars, order in rows:
            user_stars[user].append(stars)
            item_stars[item].append(stars)
            if (user, item) not in last or order > last[user, item][0]:
                last[user, item] = (order, stars)
        for (user, item), (_, stars) in last.items():
            self.by_item[item][user] = stars
            self.by_user[user][item] = stars
        self.user_mean = {k: fmean(v) for k, v in user_stars.items()}
        self.item_mean = {k: fmean(v) for k, v in item_stars.items()}

    def common(self, a, b):
        users = set(self.by_item.get(a, {})) & set(self.by_item.get(b, {}))
        return [(self.by_item[a][u], self.by_item[b][u]) for u in sorted(users)]

    def pearson(self, a, b):
        if a not in self.item_mean or b not in self.item_mean:
            return 0.0
        both = self.common(a, b)
        if len(both) <= 2:
            return max(1 - abs(self.item_mean[a] - self.item_mean[b]) / 5, 0)
        xs, ys = zip(*both)
        mx, my = fmean(xs), fmean(ys)
        if len(set(xs)) == 1 or len(set(ys)) == 1:
            return 0.0
        cov = sum((x - mx) * (y - my) for x, y in both)
        return cov / (sqrt(sum((x - mx) ** 2 for x in xs)) * sqrt(sum((y - my) ** 2 for y in ys)))

    def cosine(self, a, b, shrinkage=10):
        both = self.common(a, b)
        if not both:
            return 0.0
        xs, ys = zip(*both)
        dot = sum(x * y for x, y in both)
        n = len(both)
        return n / (n + shrinkage) * dot / (sqrt(sum(x * x for x in xs)) * sqrt(sum(y * y for y in ys)))

    def near(self, user, target, similarity, keep, k, exclude=False):
        found = [
            (similarity(item, target), item, stars)
            for item, stars in self.by_user.get(user, {}).items()
            if not (exclude and item == target)
        ]
        found = [f for f in found if keep(f[0])]
        return sorted(found, key=lambda f: (-round(f[0], 12), f[1]))[:k]

    def predict_pearson(self, user, target, k=10):
        near = self.near(user, target, self.pearson, lambda s: abs(s) > 1e-15, k)
        weight = sum(abs(s) for s, _, _ in near)
        if not weight:
            return self.user_mean.get(user, 3.45)
        return (self.user_mean[user] + sum(s * r for s, _, r in near) / weight) / 2

    def predict_cosine(self, user, target, k=15, exclude=False):
        near = self.near(user, target, self.cosine, lambda s: s > 0, k, exclude)
        if not near:
            return (self.user_mean.get(user, 3.45) + self.item_mean.get(target, 3.45)) / 2
        value = sum(s * r for s, _, r in near) / sum(s for s, _, _ in near)
        return min(max(value, 1.0), 5.0)
