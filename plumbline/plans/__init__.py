"""Query plans. ``load()`` imports the modules, which registers their queries."""


def load() -> None:
    from plumbline.plans import assembly, checks, evaluation, features, learning, reports, sampling, spans, text, windows  # noqa: F401
