"""Words that collide under any polynomial hash modulo 2^64: a Thue-Morse word and its complement."""


def thue_morse(n):
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))
