"""Model factories for the command line's tests."""


class Weighing:
    def __call__(self, asked):
        return ['{"verdict":"real"}' for _ in asked]

    def mean_logprobs(self, asked, candidate):
        return [float(candidate in ("manipulated", "yes")) for _ in asked]


def plain():
    return lambda asked: ["x" for _ in asked]
