"""Digests (see licenses.digest_of) of whole licences as Debian ships them, by SPDX name;
without appendix: up to the line "END OF TERMS AND CONDITIONS"."""

DIGESTS = {
    "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f": "Apache-2.0",
    "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93": "Apache-2.0 (without appendix)",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f": "GFDL-1.2",
    "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0 (without appendix)",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0 (without appendix)",
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0 (without appendix)",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0 (without appendix)",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1 (without appendix)",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986": "MPL-1.1",
    "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6": "MPL-2.0",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
}
