"""Fixed values of molecular biology: codes, stacks, masses, enzymes. Public facts, stated as they are."""

from __future__ import annotations

from itertools import product

# --- fixed values: the standard genetic code in TCAG order, and the other codes as changes to it ---
BASES = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODES = {  # table id: (changed codons, starts)
    1: ({}, "TTG CTG ATG"),
    2: ({"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, "ATT ATC ATA ATG GTG"),
    3: ({"TGA": "W", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "ATA": "M"}, "ATA ATG GTG"),
    4: ({"TGA": "W"}, "TTA TTG CTG ATT ATC ATA ATG GTG"),
    5: ({"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S"}, "TTG ATT ATC ATA ATG GTG"),
    6: ({"TAA": "Q", "TAG": "Q"}, "ATG"),
    9: ({"TGA": "W", "AAA": "N", "AGA": "S", "AGG": "S"}, "ATG GTG"),
    10: ({"TGA": "C"}, "ATG"),
    11: ({}, "TTG CTG ATT ATC ATA ATG GTG"),
    12: ({"CTG": "S"}, "CTG ATG"),
    13: ({"TGA": "W", "ATA": "M", "AGA": "G", "AGG": "G"}, "TTG ATA ATG GTG"),
    14: ({"TAA": "Y", "TGA": "W", "AAA": "N", "AGA": "S", "AGG": "S"}, "ATG"),
    15: ({"TAG": "Q"}, "ATG"),
    16: ({"TAG": "L"}, "ATG"),
    21: ({"TGA": "W", "ATA": "M", "AAA": "N", "AGA": "S", "AGG": "S"}, "ATG GTG"),
    22: ({"TCA": "*", "TAG": "L"}, "ATG"),
    23: ({"TTA": "*"}, "ATT ATG GTG"),
    24: ({"TGA": "W", "AGA": "S", "AGG": "K"}, "TTG CTG ATG GTG"),
    25: ({"TGA": "G"}, "TTG ATG GTG"),
    26: ({"CTG": "A"}, "CTG ATG"),
    29: ({"TAA": "Y", "TAG": "Y"}, "ATG"),
    30: ({"TAA": "E", "TAG": "E"}, "ATG"),
    32: ({"TAG": "W"}, "TTG CTG ATT ATC ATA ATG GTG"),
    33: ({"TAA": "Y", "TGA": "W", "AGA": "S", "AGG": "K"}, "TTG CTG ATG GTG"),
}
# --- fixed values: IUPAC symbols ---
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT = ("ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn")
# --- fixed values: nearest-neighbour stacks (kcal/mol, cal/mol K), SantaLucia 1998 ---
STACKS = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
END_GC, END_AT, SYMMETRY_DS = (0.1, -2.8), (2.3, 4.1), -1.4
# --- fixed values: masses (Dalton) ---
NUCLEOTIDE_MASS = {"average": {"A": 331.2218, "C": 307.1971, "G": 347.2212, "T": 322.2085}, "monoisotopic": {"A": 331.06817, "C": 307.056936, "G": 347.063084, "T": 322.056602}}
NUCLEOTIDE_WATER = {"average": 18.0153, "monoisotopic": 18.010565}
PHOSPHATE = {"average": 79.9663, "monoisotopic": 79.966331}
RESIDUE_MASS = {
    "G": 57.052, "A": 71.079, "V": 99.133, "L": 113.160, "I": 113.160, "P": 97.117, "F": 147.177, "W": 186.213, "M": 131.199, "S": 87.078,
    "T": 101.105, "C": 103.145, "Y": 163.176, "H": 137.141, "D": 115.089, "E": 129.116, "N": 114.104, "Q": 128.131, "K": 128.174, "R": 156.188,
}
RESIDUE_OTHER, RESIDUE_WATER = 111.1, 18.015
# --- fixed values: restriction enzymes: recognition, top cut, bottom cut, counted from the site's start ---
ENZYMES = {
    "AluI": ("AGCT", 2, 2), "DpnI": ("GATC", 2, 2), "DpnII": ("GATC", 0, 4), "HaeIII": ("GGCC", 2, 2), "HhaI": ("GCGC", 3, 1),
    "HpaII": ("CCGG", 1, 3), "MboI": ("GATC", 0, 4), "MseI": ("TTAA", 1, 3), "MspI": ("CCGG", 1, 3), "RsaI": ("GTAC", 2, 2), "Sau3AI": ("GATC", 0, 4),
    "TaqI": ("TCGA", 1, 3), "Tsp509I": ("AATT", 0, 4), "CfoI": ("GCGC", 3, 1), "Csp6I": ("GTAC", 1, 3), "EcoRI": ("GAATTC", 1, 5),
    "BamHI": ("GGATCC", 1, 5), "HindIII": ("AAGCTT", 1, 5), "XbaI": ("TCTAGA", 1, 5), "SalI": ("GTCGAC", 1, 5), "PstI": ("CTGCAG", 5, 1),
    "XhoI": ("CTCGAG", 1, 5), "NcoI": ("CCATGG", 1, 5), "NdeI": ("CATATG", 2, 4), "SpeI": ("ACTAGT", 1, 5), "KpnI": ("GGTACC", 5, 1),
    "SacI": ("GAGCTC", 5, 1), "SmaI": ("CCCGGG", 3, 3), "BglII": ("AGATCT", 1, 5), "ClaI": ("ATCGAT", 2, 4), "EcoRV": ("GATATC", 3, 3),
    "AgeI": ("ACCGGT", 1, 5), "NheI": ("GCTAGC", 1, 5), "MluI": ("ACGCGT", 1, 5), "ScaI": ("AGTACT", 3, 3), "ApaI": ("GGGCCC", 5, 1),
    "SphI": ("GCATGC", 5, 1), "NotI": ("GCGGCCGC", 2, 6), "AatII": ("GACGTC", 5, 1), "AccI": ("GTMKAC", 2, 4), "AflII": ("CTTAAG", 1, 5),
    "ApaLI": ("GTGCAC", 1, 5), "AscI": ("GGCGCGCC", 2, 6), "AseI": ("ATTAAT", 2, 4), "AvrII": ("CCTAGG", 1, 5), "BclI": ("TGATCA", 1, 5),
    "BlpI": ("GCTNAGC", 2, 5), "BmtI": ("GCTAGC", 5, 1), "BsiWI": ("CGTACG", 1, 5), "BspEI": ("TCCGGA", 1, 5), "BspHI": ("TCATGA", 1, 5),
    "BsrGI": ("TGTACA", 1, 5), "BstBI": ("TTCGAA", 2, 4), "BstEII": ("GGTNACC", 1, 6), "BstXI": ("CCANNNNNNTGG", 8, 4), "DraI": ("TTTAAA", 3, 3),
    "EagI": ("CGGCCG", 1, 5), "FseI": ("GGCCGGCC", 6, 2), "FspI": ("TGCGCA", 3, 3), "HincII": ("GTYRAC", 3, 3), "HpaI": ("GTTAAC", 3, 3),
    "KasI": ("GGCGCC", 1, 5), "MfeI": ("CAATTG", 1, 5), "NarI": ("GGCGCC", 2, 4), "NgoMIV": ("GCCGGC", 1, 5), "NruI": ("TCGCGA", 3, 3),
    "NsiI": ("ATGCAT", 5, 1), "PacI": ("TTAATTAA", 5, 3), "PciI": ("ACATGT", 1, 5), "PmeI": ("GTTTAAAC", 4, 4), "PmlI": ("CACGTG", 3, 3),
    "PpuMI": ("RGGWCCY", 2, 5), "PsiI": ("TTATAA", 3, 3), "PvuI": ("CGATCG", 4, 2), "PvuII": ("CAGCTG", 3, 3), "SacII": ("CCGCGG", 4, 2),
    "SbfI": ("CCTGCAGG", 6, 2), "SfoI": ("GGCGCC", 3, 3), "SgrAI": ("CRCCGGYG", 2, 6), "SnaBI": ("TACGTA", 3, 3), "SrfI": ("GCCCGGGC", 4, 4),
    "StuI": ("AGGCCT", 3, 3), "SwaI": ("ATTTAAAT", 4, 4), "XmaI": ("CCCGGG", 1, 5), "BspDI": ("ATCGAT", 2, 4), "BspMII": ("TCCGGA", 1, 5),
    "BstYI": ("RGATCY", 1, 5), "Cfr10I": ("RCCGGY", 1, 5), "DraIII": ("CACNNNGTG", 6, 3), "AlwNI": ("CAGNNNCTG", 6, 3), "EcoO109I": ("RGGNCCY", 2, 5),
    "MscI": ("TGGCCA", 3, 3), "NaeI": ("GCCGGC", 3, 3), "PaeR7I": ("CTCGAG", 1, 5), "SfiI": ("GGCCNNNNNGGCC", 8, 5), "SgrDI": ("CGTCGACG", 2, 6),
    "SstI": ("GAGCTC", 5, 1), "SstII": ("CCGCGG", 4, 2), "XhoII": ("RGATCY", 1, 5), "XmaIII": ("CGGCCG", 1, 5), "AsiSI": ("GCGATCGC", 5, 3),
    "Sse8387I": ("CCTGCAGG", 6, 2), "Sse8647I": ("AGGWCCT", 2, 5), "BsaI": ("GGTCTC", 7, 11), "BbsI": ("GAAGAC", 8, 12), "BsmBI": ("CGTCTC", 7, 11),
    "Esp3I": ("CGTCTC", 7, 11), "SapI": ("GCTCTTC", 8, 11), "BtgZI": ("GCGATG", 16, 20), "BpiI": ("GAAGAC", 8, 12), "LguI": ("GCTCTTC", 8, 11),
    "BsmFI": ("GGGAC", 15, 19), "BspQI": ("GCTCTTC", 8, 11), "AclI": ("AACGTT", 2, 4), "AflIII": ("ACRYGT", 1, 5), "AhdI": ("GACNNNNNGTC", 6, 5),
    "AleI": ("CACNNNNGTG", 5, 5), "BglI": ("GCCNNNNNGGC", 7, 4), "BsaBI": ("GATNNNNATC", 5, 5), "BsiEI": ("CGRYCG", 4, 2),
    "BsiHKAI": ("GWGCWC", 5, 1), "BsoBI": ("CYCGRG", 1, 5), "BsrFI": ("RCCGGY", 1, 5), "BstAPI": ("GCANNNNNTGC", 7, 4), "BstZ17I": ("GTATAC", 3, 3),
    "BtgI": ("CCRYGG", 1, 5), "DrdI": ("GACNNNNNNGTC", 7, 4), "EarI": ("CTCTTC", 7, 10), "EspI": ("GCTNAGC", 2, 5), "MlsI": ("TGGCCA", 3, 3),
    "MluCI": ("AATT", 0, 4), "NspI": ("RCATGY", 5, 1), "SfeI": ("CTRYAG", 1, 5), "XcmI": ("CCANNNNNNNNNTGG", 12, 9), "ZraI": ("GACGTC", 3, 3),
    "AvaI": ("CYCGRG", 1, 5), "AvaII": ("GGWCC", 1, 4), "BalI": ("TGGCCA", 3, 3), "BcuI": ("ACTAGT", 1, 5), "BmgBI": ("CACGTC", 3, 3),
    "BsrBI": ("CCGCTC", 3, 3), "BssSI": ("CACGAG", 1, 5), "BssHII": ("GCGCGC", 1, 5), "CsiI": ("ACCGGT", 1, 5), "Eco53kI": ("GAGCTC", 3, 3),
    "EcoT22I": ("ATGCAT", 5, 1), "HindII": ("GTYRAC", 3, 3), "MboII": ("GAAGA", 13, 12), "TasI": ("AATT", 0, 4), "TfiI": ("GAWTC", 1, 4),
    "TseI": ("GCWGC", 1, 4), "Tth111I": ("GACNNNGTC", 4, 5),
}
# --- fixed values: methylation: target and state that a site needs to be cut; enzymes whose sites depend on context ---
METHYLATION = {"DpnI": ("dam", "methylated"), "DpnII": ("dam", "unmethylated"), "MboI": ("dam", "unmethylated"), "HhaI": ("cpg", "unmethylated"), "HpaII": ("cpg", "unmethylated")}
CONTEXT_DEPENDENT = {"MspI"}
# --- fixed values: named lists of enzymes ---
PRESETS = {
    "golden-gate-type-iis": ["BsaI", "BbsI", "BsmBI", "Esp3I", "SapI", "BspQI"],
    "common-mcs": ["EcoRI", "BamHI", "HindIII", "XbaI", "SalI", "PstI", "NotI", "XhoI", "NcoI", "NdeI", "SpeI", "KpnI", "SacI", "SmaI", "BglII", "ClaI", "EcoRV", "AgeI", "NheI", "MluI"],
    "classic-6-cutter": ["EcoRI", "BamHI", "HindIII", "XbaI", "SalI", "PstI", "NotI", "XhoI", "NcoI", "NdeI", "SpeI", "KpnI", "SacI", "SmaI", "BglII", "ClaI", "EcoRV", "ScaI", "ApaI", "SphI"],
    "diagnostic-screening": ["AluI", "HaeIII", "TaqI", "HpaII", "MspI", "DpnI", "MboI", "Sau3AI", "RsaI", "MseI", "Tsp509I", "HhaI"],
}
# --- fixed values: nicking enzymes: recognition, place of the one cut, strand ---
NICKASES = {"Nb.BbvCI": ("CCTCAGC", 9, "bottom"), "Nt.BbvCI": ("CCTCAGC", 2, "top"), "Nt.BstNBI": ("GAGTC", 9, "top")}


def code_string(table_id: int = 1) -> str:
    """64 residues in TCAG order."""
    changed = CODES[table_id][0]
    return "".join(changed.get("".join(c), aa) for c, aa in zip(product(BASES, repeat=3), STANDARD, strict=True))


def reverse_complement(s: str) -> str:
    return s[::-1].translate(str.maketrans(*COMPLEMENT))


def concrete(pattern: str) -> list[str]:
    """All base strings that an IUPAC pattern stands for."""
    return ["".join(p) for p in product(*(IUPAC[c] for c in pattern))]
