"""Named plans. ``all_queries`` imports every core module that registers some."""


def all_queries() -> tuple[dict, dict]:
    from importlib import import_module

    from millrace.plans.registry import ORACLES, QUERIES

    for module in MODULES:
        import_module(f"millrace.plans.{module}")
    return dict(QUERIES), dict(ORACLES)


MODULES = ["curate", "evaluate", "relate", "chat", "sequence", "storage"]
