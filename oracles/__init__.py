"""SQL that states each query's expected result on the same tables."""


def all_oracles() -> dict[str, str]:
    from oracles import assembly, rest, text, urls

    out: dict[str, str] = {}
    for module in (urls, text, assembly, rest):
        out.update(module.ORACLES)
    return out
